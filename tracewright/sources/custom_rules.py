"""Text logs described by rules: a rule is compiled to column expressions, nothing runs per line in Python.

A rule is a mapping (the shape of its YAML): ``prefilter`` (contains_any, contains_all) and
``parsers``, tried in order; the first whose ``match`` (contains, contains_any, regex) and
``extract`` (csv, regex or keyvalue) succeed gives the row.  ``sub_extract`` reads one extracted
field again, and its failure is ignored.  ``map`` fills columns from ``${name}`` templates.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.net import bound
from tracewright.schema import TIMELINE

# Internal names of columns in rules, and the keys a rule may have.
ALIASES = {"computer": "dst_computer", "workstation_name": "src_computer", "ip_address": "src_ip", "filename": "log_filename"}
KEYS = {"meta", "prefilter", "parsers", "name", "match", "extract", "sub_extract", "map", "contains", "contains_any", "contains_all", "regex"}
EMPTY = "map<string,string>"


def example(kind: str) -> dict:
    """Small rules of each kind, used by the registered queries."""
    if kind == "csv":
        extract = {"csv": {"delimiter": ",", "quote": '"', "columns": {0: "kind", 1: "verb", 2: "user", 3: "host"}}}
        return {"prefilter": {"contains_any": ["VPN"]}, "parsers": [{"name": "login", "match": {"contains": "login"}, "extract": extract, "map": {"target_user_name": "${user}", "workstation_name": "${host}"}}]}
    if kind == "regex":
        return {"parsers": [{"name": "accepted", "match": {"contains_any": ["accepted"]}, "extract": {"regex": r"accepted user (?P<user>\S+) from (?P<src_addr>[\d.]+)"}, "map": {"target_user_name": "${user}", "ip_address": "${src_addr}"}}]}
    return {"parsers": [{"name": "kv", "match": {"contains": "type=vpn"}, "extract": {"keyvalue": {"pair_sep": " ", "kv_sep": "="}}, "map": {"target_user_name": "${user}", "detail": "${reason}"}}]}


def load(rules: list[dict]) -> list[dict]:
    """Checked rules; unknown keys and bad patterns are errors."""
    for rule in rules:
        for part in [rule, *rule.get("parsers", [])]:
            if unknown := set(part) - KEYS:
                raise ValueError(f"unknown keys {sorted(unknown)}")
        for p in rule.get("parsers", []):
            for pattern in filter(None, [p.get("match", {}).get("regex"), p.get("extract", {}).get("regex")]):
                re.compile(pattern)
    return rules


def load_files(path: str) -> list[dict]:
    """Rules of a YAML file or folder, in sorted order; needs PyYAML."""
    import yaml

    found = Path(path)
    files = sorted(x for x in found.rglob("*") if x.suffix in (".yaml", ".yml")) if found.is_dir() else [found]
    return load([r for f in files if isinstance(r := yaml.safe_load(f.read_text(encoding="utf-8")), dict)])


def java_pattern(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """A pattern with its named groups as positional ones, in Unicode mode with line ends at \\n only."""
    names = sorted(re.compile(pattern).groupindex.items(), key=lambda x: x[1])
    out = re.sub(r"\(\?P<\w+>", "(", pattern)
    return "(?Ud)" + re.sub(r"(?<!\\)\$$", r"\\z", out), names


def _contains(line: Column, spec: dict) -> Column:
    out = F.lit(True)
    if any_ := spec.get("contains_any"):
        one = F.lit(False)
        for n in any_:
            one = one | line.contains(n)
        out = out & one
    for n in spec.get("contains_all", []) or []:
        out = out & line.contains(n)
    return out


def _matches(line: Column, spec: dict) -> Column:
    if not spec:
        return F.lit(False)
    out = _contains(line, spec)
    if spec.get("contains"):
        out = out & line.contains(spec["contains"])
    if spec.get("regex"):
        out = out & line.rlike(java_pattern(spec["regex"])[0])
    return out


def csv_fields(line: Column, delimiter: str = ",", quote: str | None = None) -> Column:
    """Trimmed fields.  With a quote, delimiters inside quotes do not cut and doubled quotes are one.

    A quote that is never closed holds the rest of the line.  The patterns are possessive, so a line
    of any length is read once and without recursion.
    """
    if not quote:
        return F.transform(F.split(line, re.escape(delimiter), -1), F.trim)
    return F.transform(quoted_fields(line, delimiter, quote), lambda x: F.trim(unquoted(F.trim(x), quote)))


def unquoted(field: Column, quote: str) -> Column:
    """A field without the quotes around its quoted runs; doubled ones inside stand for one."""
    q = re.escape(quote)
    return F.replace(F.regexp_replace(field, f"(?s){q}((?:[^{q}]++|{q}{q})*+)(?:{q}|\\z)", "$1"), F.lit(quote * 2), F.lit(quote))


def quoted_fields(line: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """The fields of a line as they stand, cut at delimiters outside quotes."""
    d, q = re.escape(delimiter), re.escape(quote)
    return F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f"(?s){d}((?:[^{q}{d}]++|{q}[^{q}]*+(?:{q}|\\z))*+)"), F.lit(1))


def key_values(line: Column, pair_sep: str = " ", kv_sep: str = "=") -> Column:
    """Map of keys to values, cut at the first kv separator; double, then single quotes are stripped.

    Pairs are cut at every separator, inside quotes too; the last value of a key wins.
    """
    at = lambda x: F.instr(x, kv_sep)
    value = lambda x: F.btrim(F.btrim(F.trim(x.substr(at(x) + len(kv_sep), F.length(x))), F.lit('"')), F.lit("'"))
    pair = lambda x, k: F.struct(F.trim(x.substr(F.lit(1), at(x) - 1)).alias("key"), k.alias("k"), value(x).alias("value"))
    pairs = F.transform(F.filter(F.split(line, re.escape(pair_sep), -1), lambda x: F.instr(x, kv_sep) > 0), pair)
    return bound(F.filter(pairs, lambda p: p["key"] != ""), last_wins)


def last_wins(pairs: Column) -> Column:
    """Map of (key, k, value) structs; of equal keys the one of the highest k.

    Sorted by key and place, a pair is the last of its key where the next one has another key.
    """

    def kept(ordered: Column) -> Column:
        return F.filter(ordered, lambda p, n: ~F.coalesce(F.get(ordered, n + 1)["key"] == p["key"], F.lit(False)))

    return bound(F.array_sort(pairs), lambda ordered: F.map_from_entries(F.transform(kept(ordered), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))))


def _extract(line: Column, spec: dict) -> tuple[Column, Column]:
    """(succeeds, map of fields)."""
    if "csv" in spec:
        s = spec["csv"]
        fields = csv_fields(line, s.get("delimiter", ","), s.get("quote"))
        entries = [F.struct(F.lit(n).alias("key"), F.coalesce(F.try_element_at(fields, F.lit(int(k) + 1)), F.lit("")).alias("value")) for k, n in s["columns"].items()]
        return F.lit(True), F.map_from_entries(F.array(*entries))
    if "regex" in spec:
        pattern, names = java_pattern(spec["regex"])
        entries = [F.struct(F.lit(n).alias("key"), F.regexp_extract(line, pattern, k).alias("value")) for n, k in names]
        return line.rlike(pattern), F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast(EMPTY)
    s = spec.get("keyvalue") or {}
    return F.lit(True), key_values(line, s.get("pair_sep", " "), s.get("kv_sep", "="))


def template(text: str, fields: Column) -> Column:
    """``${name}`` replaced by the field, an unknown one by nothing; an unclosed one stays."""
    parts = []
    for k, piece in enumerate(re.split(r"\$\{([^}]*)\}", text)):
        if k % 2:
            parts.append(F.coalesce(F.try_element_at(fields, F.lit(piece)), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def _joined(base: Column, more: Column) -> Column:
    """Fields of both maps; those of ``more`` win."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)


def parse(lines: DataFrame, rules: list[dict], line_col: str = "line", carry: list[str] | None = None, file_col: str | None = None, number_col: str | None = None) -> DataFrame:
    """Timeline rows of the lines that some parser takes, with ``carry`` and the parser's name."""
    line = F.col(line_col)
    specials = [F.struct(F.lit(n).alias("key"), (F.col(c).cast("string") if c else F.lit("")).alias("value")) for n, c in (("__source_file", file_col), ("__line_number", number_col))]
    chosen = F.lit(None).cast(f"struct<parser:string,{','.join(f'{c}:string' for c in TIMELINE)}>")
    file = F.col(file_col).cast("string") if file_col else F.lit("")

    def row(p: dict, fields: Column) -> Column:
        mapped = {ALIASES.get(k, k): template(str(v), fields) for k, v in p.get("map", {}).items()}
        mapped["log_filename"] = F.coalesce(F.nullif(mapped["log_filename"], F.lit("")), file) if "log_filename" in mapped else file
        return F.struct(F.lit(p.get("name", "")).alias("parser"), *[mapped.get(c, F.lit("")).alias(c) for c in TIMELINE])

    def sub_fields(sub: dict, fields: Column) -> Column:
        text = F.coalesce(F.try_element_at(fields, F.lit(sub["field"])), F.lit(""))
        if needle := sub.get("strip_before"):
            text = bound(text, lambda t: F.when(F.instr(t, needle) > 0, t.substr(F.instr(t, needle) + len(needle), F.length(t))).otherwise(t))
        return bound(text, lambda t: F.when(_extract(t, sub)[0], _joined(fields, _extract(t, sub)[1])).otherwise(fields))

    for rule in reversed(rules):
        before = _contains(line, rule.get("prefilter") or {})
        for p in reversed(rule.get("parsers", [])):
            ok, fields = _extract(line, p["extract"])
            fields = _joined(F.map_from_entries(F.array(*specials)), fields) if _uses_specials(p) else fields
            made = bound(fields, _row_maker(p, row, sub_fields))
            chosen = F.when(before & _matches(line, p.get("match") or {}) & ok, made).otherwise(chosen)
    # through a generator, so that the filter and each column use the row instead of computing it again
    kept = lines.select(*(carry or []), F.explode(F.array(chosen)).alias("__row")).where("__row IS NOT NULL")
    return kept.select("__row.*", *(carry or []))


def _row_maker(p: dict, row: Callable, sub_fields: Callable) -> Callable[[Column], Column]:
    """Row of a parser from its fields; each step is bound to a name, so that it runs once a line however many templates refer to it."""
    if sub := p.get("sub_extract"):
        return lambda fields: bound(sub_fields(sub, fields), lambda more: row(p, more))
    return lambda fields: row(p, fields)


def _uses_specials(p: dict) -> bool:
    return "__source_file" in str(p) or "__line_number" in str(p)


def rejected(lines: DataFrame, rules: list[dict], line_col: str = "line", limit: int = 20) -> DataFrame:
    """A sample of the lines that no parser takes."""
    taken = parse(lines.withColumn("__k", F.monotonically_increasing_id()), rules, line_col, ["__k", line_col])
    return lines.join(taken.select(F.col(line_col).alias("__l")).distinct(), F.col(line_col) == F.col("__l"), "left_anti").limit(limit)


def hits(rows: DataFrame) -> DataFrame:
    return rows.groupBy("parser").agg(F.count(F.lit(1)).alias("n"))
