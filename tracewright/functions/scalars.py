"""Scalar functions over timeline columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event ids by meaning, status texts, noise values.
NETWORK_LOGON_IDS = ("4768", "4769", "4770", "4771", "4776", "5140", "4648", "6")
SUBSTATUS = {
    "0xc000006a": "Wrong password",
    "0xc0000064": "User does not exist",
    "0xc0000072": "Account disabled",
    "0xc0000234": "Account locked out",
    "0xc0000070": "Logon outside allowed hours",
    "0xc000006d": "Bad username or auth info",
    "0xc0000071": "Expired password",
    "0xc0000224": "Password must change",
    "0xc0000193": "Account expired",
    "0xc000015b": "Logon type not granted",
    "0xc000006e": "Unknown user or bad password",
    "0xc0000133": "Clock skew too great",
    "0xc0000005": "Access denied",
}
LOCAL = ("LOCAL", "127.0.0.1", "::1", "::", "0.0.0.0", "DEFAULT_VALUE", '""', "-", "", " ")
SUCCESS_IDS = ("4624", "4648", "4778", "1149", "21", "25", "SSH_SUCCESS")
FAILED_IDS = ("4625", "4771", "551", "1009", "31001", "SSH_FAILED")
LOGOFF_IDS = ("4634", "4647", "4779", "22", "24")


def infer_logon_type(event_id: Column, raw: Column) -> Column:
    return F.when(raw != "", raw).when(event_id.isin(*NETWORK_LOGON_IDS), "3").otherwise("")


def strip_mapped(ip: Column) -> Column:
    """IPv4 out of an IPv4-mapped IPv6 address; link-local IPv6 becomes empty."""
    mapped = ip.startswith("::ffff:") & ip.contains(".")
    return F.when(mapped, F.substring(ip, 8, 64)).when(ip.startswith("fe80:"), "").otherwise(ip)


def substatus(code: Column) -> Column:
    """The meaning of an NTSTATUS code followed by the code; an unknown code unchanged."""
    out = code
    for k, text in SUBSTATUS.items():
        out = F.when(F.lower(code) == k, F.concat(F.lit(f"{text} ("), code, F.lit(")"))).otherwise(out)
    return out


def classify(event_id: Column, status: Column) -> Column:
    kerberos = event_id.isin("4768", "4769", "4770", "4776")
    return (
        F.when(event_id.isin(*SUCCESS_IDS), "SUCCESSFUL_LOGON")
        .when(event_id.isin(*FAILED_IDS), "FAILED_LOGON")
        .when(event_id.isin(*LOGOFF_IDS), "LOGOFF")
        .when(kerberos, F.when(status.isin("", "0x0"), "SUCCESSFUL_LOGON").otherwise("FAILED_LOGON"))
        .otherwise("CONNECT")
    )


def detail(event_id: Column, process: Column, sub: Column, share: Column, relative: Column) -> Column:
    shared = F.when(relative != "", F.concat_ws("\\", share, relative)).otherwise(share)
    return F.when(event_id.isin("4625", "4771", "4776"), substatus(sub)).when(event_id == "5140", shared).otherwise(process)


def domain_of(user: Column) -> Column:
    return F.when(user.contains("\\"), F.substring_index(user, "\\", 1)).otherwise("")


def user_of(user: Column) -> Column:
    return F.when(user.contains("\\"), F.regexp_extract(user, r"^[^\\]*\\([^\\]*)", 1)).otherwise(user)


def winrm_host(connection: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(connection, "^[A-Za-z]+://", ""), r"^([^/:]*)", 1)


def short_host(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def ip_like(text: Column, parity: bool = True) -> Column:
    """Whether a name looks like an address.  Parity: digits and dots, or hex digits and colons,
    so that the empty string and BEEF do; otherwise a dotted quad or something with a colon."""
    if parity:
        return text.rlike(r"^[0-9.]*$") | text.rlike(r"^[0-9A-Fa-f:]*$")
    return text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | (text.contains(":") & text.rlike(r"^[0-9A-Fa-f:.]+$"))


def leading_ip(text: Column) -> Column:
    """The leading digits, dots and colons if there is a dot or colon among them, else null."""
    return F.when(text.rlike("^[0-9]*[.:]"), F.regexp_extract(text, "^[0-9.:]*", 0))


def upper_name(text: Column) -> Column:
    """Upper case without brackets and backslashes."""
    return F.upper(F.translate(text, "\\[]", ""))


def clean_host(up: Column, parity: bool = True) -> Column:
    """An upper-case name reduced to an address or a bare host name.

    Parity keeps the leading run of digits, dots and colons (so IPv6 is cut) and takes any name
    of hex digits for an address; otherwise whole addresses stay, ports go, and names end at the
    first dot or colon.  ``up`` is used several times: pass a column, not an expression.
    """
    if parity:
        address = F.regexp_extract(up, r"^(?:(?=[0-9.:]*\.)(?=[0-9.:]*:)[0-9.]*(?=:)|[0-9.:]*)", 0)
        name = F.regexp_extract(up, r"^(?:[0-9A-F:]*(?=\.)|[^.:]*)", 0)
        return F.when(up.rlike("^[0-9]*[.:]"), address).when(up.rlike("^[0-9A-F:]*$"), up).otherwise(name)
    quad = r"^\d{1,3}(?:\.\d{1,3}){3}"
    return F.when(up.rlike(quad), F.regexp_extract(up, quad, 0)).when(up.rlike("^[0-9A-F.]*:[0-9A-F:.]*$"), up).otherwise(F.regexp_extract(up, "^[^.:]*", 0))


def rel_type(user: Column) -> Column:
    """A user as a relation name: upper case, without what follows @, other marks as underscores."""
    name = F.regexp_replace(F.substring_index(user, "@", 1), "[^A-Za-z0-9_]", "_")
    return F.upper(F.when(F.trim(user) == "", "NO_USER").when(name == "", "NO_USER").when(name.rlike("^[0-9]"), F.concat(F.lit("u"), name)).otherwise(name))


def clean_user(user: Column) -> Column:
    return F.substring_index(user, "@", 1)


def port_logon_type(port: Column) -> Column:
    p = port.try_cast("int")
    return F.when(p.isin(3389, 5900), "10").when(p.isin(445, 135, 139, 5985, 5986, 1433, 3306), "3").when(p == 22, "SSH")


def port_bucket(port: Column) -> Column:
    p = port.try_cast("int")
    return F.when(p == 3389, "RDP").when(p == 445, "SMB").when(p == 22, "SSH").otherwise("OTHER")


def role_logon_type(role: Column) -> Column:
    """(tag of an access-logging role) by its name, first match."""
    low = F.lower(role)
    return F.when(low.contains("file"), "3").when(low.contains("remote"), "10").when(low.contains("active directory"), "3").otherwise("")


def hex_ip(text: Column) -> Column:
    """Space-separated hex bytes as an address: 4 bytes v4, 16 bytes v6 (mapped ones as v4)."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x.rlike("^[0-9A-Fa-f]{1,2}$"))
    number = lambda x: F.conv(x, 16, 10)
    v4 = lambda p: F.array_join(F.transform(p, number), ".")
    mapped = F.array_join(F.slice(parts, 1, 12), "").rlike("(?i)^(00){10}ffff$")
    loop = F.array_join(parts, "").rlike("^(00){15}01$")
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lower(F.regexp_replace(F.concat(F.lpad(parts[k * 2], 2, "0"), F.lpad(parts[k * 2 + 1], 2, "0")), "^0{1,3}", ""))), ":")
    return F.when(F.size(parts) == 4, v4(parts)).when(F.size(parts) == 16, F.when(mapped, v4(F.slice(parts, 13, 4))).when(loop, "::1").otherwise(groups)).otherwise("")


def tag_text(document: Column, tag: str) -> Column:
    """The first element's trimmed text, exact tag without attributes."""
    return F.trim(F.regexp_extract(document, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def csv_escape(text: Column) -> Column:
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def vss_index(path: Column) -> Column:
    return F.regexp_extract(path, r"_vss_(\d+)", 1).try_cast("int")
