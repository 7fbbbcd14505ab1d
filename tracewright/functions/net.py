"""Address predicates: strict IPv4 as a number, IPv6 as 32 hex digits, lists of addresses and networks."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def v4_number(ip: Column) -> Column:
    """The address as a number; null unless it is a strict dotted quad."""
    total = lambda p: p[0].cast("long") * 16777216 + p[1].cast("long") * 65536 + p[2].cast("long") * 256 + p[3].cast("long")
    return F.when(ip.rlike(V4), bound(F.split(ip, r"\."), total))


def v6_hex(ip: Column) -> Column:
    """32 lower-case hex digits; null unless it is an IPv6 address."""
    side = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

    def groups(plain: Column) -> Column:
        left, right = side(F.substring_index(plain, "::", 1)), side(F.when(plain.contains("::"), F.substring_index(plain, "::", -1)).otherwise(""))
        return bound(F.struct(left.alias("l"), right.alias("r"), plain.contains("::").alias("gap")), filled)

    def filled(x: Column) -> Column:
        missing = 8 - F.size(x["l"]) - F.size(x["r"])
        full = F.concat(x["l"], F.array_repeat(F.lit("0"), missing), x["r"])
        return F.when((x["gap"] & (missing >= 1)) | (~x["gap"] & (missing == 0)), F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

    def embedded(x: Column) -> Column:
        number = lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535))))
        tail = F.regexp_extract(x, r"(\d+\.\d+\.\d+\.\d+)$", 1)
        return F.concat(F.regexp_replace(x, r"\d+\.\d+\.\d+\.\d+$", ""), bound(v4_number(tail), number))

    plain = F.lower(F.when(ip.contains("."), embedded(ip)).otherwise(ip))
    shape = r"^(?!.*:::)(?!.*::.*::)(?!:[^:])(?!.*[^:]:$)[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){1,8}$"
    return F.when(ip.contains(":"), bound(plain, lambda p: F.when(p.rlike(shape), groups(p))))


def valid(ip: Column) -> Column:
    return F.coalesce(ip.rlike(V4) | v6_hex(ip).isNotNull(), F.lit(False))


def in_list(ip: Column, entries: list[str]) -> Column:
    """Whether an address is one of the listed addresses or in a listed network; text that is no
    address never is, and families do not match each other.  A bad entry is a ValueError."""
    nets = [ipaddress.ip_network(e, strict=False) for e in entries]
    out = F.lit(False)
    for version, read, edge in ((4, v4_number, int), (6, v6_hex, lambda x: f"{int(x):032x}")):
        mine = [(edge(n[0]), edge(n[-1])) for n in nets if n.version == version]
        if mine:

            def inside(x: Column, mine: list = mine) -> Column:
                one = F.lit(False)
                for low, high in mine:
                    one = one | x.between(low, high)
                return F.coalesce(one, F.lit(False))

            out = out | F.coalesce(_bound(read(ip), inside), F.lit(False))
    return out


def _bound(value: Column, use: Callable) -> Column:
    return bound(value, lambda x: use(x))


def loopback_like(ip: Column) -> Column:
    """Loopback, unspecified or link-local; an IPv4-mapped loopback is not."""
    return in_list(ip, ["127.0.0.0/8", "0.0.0.0/32", "169.254.0.0/16", "::1/128", "::/128", "fe80::/10"])
