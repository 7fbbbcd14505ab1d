"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base detectors find emails, IPv4 addresses, payment cards and international phone numbers by
format.  High-recall generators propose further, overlapping spans: obfuscated emails, national
phone numbers, bank accounts, identity numbers and credentials.  Boosted trees score each
proposal from its format and its context; a threshold per kind, calibrated on held-out
examples for precision, selects.  The trees are CASE expressions, so scoring stays in the JVM.

The trees are fitted on the driver from a seeded set of made-up sentences (its size is
``EXAMPLES``), whose features come from the same expressions as those of the data.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.net import bound

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "id", "secret")
_L, _D = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# Each base pattern matches what the plain one does; possessive parts and the guards in front
# only spare it from looking at one run of characters again and again.
BASE = {
    "email": rf"(?:(?<!{_L})|\G){_L}++@{_D}++(?:\.{_D}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Runs of a secret or a local part have no upper length: possessive and guarded, they are read once.
GENERATORS = {
    "email": rf"(?i)(?<!{_L}){_L}++\s?[\[(]?\b(?:at|@)\b[\])]?\s?{_D}{{1,63}}\s?[\[(]?\b(?:dot)\b[\])]?\s?[A-Za-z]{{2,10}}\b",
    "phone": r"(?<![0-9A-Za-z.+])(?:\([0-9]{2,4}\)|0[0-9]{1,4}|[0-9]{3})[\x20./-]?[0-9]{3,4}[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,4})?(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "id": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])|(?<![0-9A-Za-z])[0-9]{8}[A-Z](?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}(?![0-9A-Za-z])",
}
CONTEXT = 28
CUES = {
    "email": r"mail|contact|write|correo|adresse|kontakt",
    "phone": r"tel|phone|call|mobil|fax|anruf|llam|appel",
    "iban": r"iban|account|konto|compte|cuenta|bank",
    "id": r"ssn|social|passport|dni|ausweis|ident|tax",
    "secret": r"passw|pwd|secret|token|key|cred|auth|bearer|clave|contrase|mot de passe",
}
EXAMPLES, TREES, DEPTH, SHRINK, BINS = 2400, 24, 3, 0.3, 12
PRECISION = 0.97


CHUNK = 256
HIT = "struct<start:int,end:int,m:string,before:string,after:string>"


def scan(items: Column, zero: Column, onwards: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """struct (c: carry after the last item, out: all that was emitted) of a pass over an array.

    ``onwards`` gives the next carry from a carry and an item, ``emit`` the array of what they emit,
    of type ``kind``.  Appending copies an array, so items are taken by chunks: the copies of n items
    are n * CHUNK / 2 and (n / CHUNK)^2 / 2, not n^2 / 2.
    """
    begin = lambda carry: F.struct(carry.alias("c"), F.array().cast(f"array<{kind}>").alias("out"))
    step = lambda a, x: F.struct(onwards(a["c"], x).alias("c"), F.concat(a["out"], emit(a["c"], x)).alias("out"))

    def whole(held: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int")),
            F.array(begin(zero)),
            lambda done, k: F.concat(done, F.array(F.aggregate(F.slice(held, k * CHUNK + 1, F.lit(CHUNK)), begin(F.element_at(done, -1)["c"]), step))),
            lambda done: F.struct(F.element_at(done, -1)["c"].alias("c"), F.flatten(F.transform(done, lambda r: r["out"])).alias("out")),
        )

    return bound(items, lambda held: F.when(F.size(held) > 0, whole(held)).otherwise(begin(zero)))


def found(text: Column, pattern: str) -> Column:
    """All matches, leftmost and not overlapping: array of (start, end, m, before, after).

    ``split`` gives the pieces between the matches; running lengths give the code point offsets.
    Texts without a match are not split.
    """

    def place(hits: Column, pieces: Column) -> Column:
        rows = F.arrays_zip(hits.alias("m"), F.slice(pieces, F.lit(1), F.size(hits)).alias("b"), F.slice(pieces, F.lit(2), F.size(hits)).alias("a"))

        def hit(at: Column, x: Column) -> Column:
            start = at + F.length(x["b"])
            near = F.right(x["b"], F.lit(CONTEXT)).alias("before"), F.left(x["a"], F.lit(4)).alias("after")
            return F.array(F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), *near))

        return scan(rows, F.lit(0), lambda at, x: at + F.length(x["b"]) + F.length(x["m"]), hit, HIT)["out"]

    empty = F.array().cast(f"array<{HIT}>")
    # hits and pieces are bound to names, so that each pattern runs once a text
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(F.size(h) == 0, empty).otherwise(bound(F.split(text, pattern, -1), lambda p: place(h, p))))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    marks = F.split(F.reverse(number), "")
    each = F.transform(
        F.filter(marks, lambda d: d != ""),
        lambda d, k: F.when(k % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_ok(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return m.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


FEATURES = (
    *(f"is_{k}" for k in GENERATORS),
    *(f"cue_{k}" for k in CUES),
    "length",
    "digit_share",
    "upper_share",
    "separators",
    "groups",
    "case_changes",
    "distinct_share",
    "letter_after",
    "assigned",
    "luhn_like",
)


def feature_row(kind: str, x: Column) -> Column:
    m, n = x["m"], F.length(x["m"])
    near = F.lower(x["before"])
    count = lambda p: n - F.length(F.regexp_replace(m, p, ""))
    values = [F.lit(float(kind == k)) for k in GENERATORS]
    values += [near.rlike(p).cast("double") for p in CUES.values()]
    values += [
        n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count(r"[\x20./()-]"),
        F.size(F.split(m, r"[\x20./()-]+")),
        F.size(F.split(m, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])")),
        F.size(F.array_distinct(F.split(m, ""))) / n,
        x["after"].rlike("^[A-Za-z]").cast("double"),
        x["before"].rlike(r"[=:]\s?[\"']?$").cast("double"),
        F.when(F.length(digits(m)) >= 13, luhn(F.left(digits(m), F.lit(32))).cast("double")).otherwise(F.lit(0.0)),
    ]
    return F.array(*[v.cast("double") for v in values])


def candidates(text: Column) -> Column:
    """Proposals of all generators: array of (kind, start, end, x: features)."""

    def proposed(kind: str) -> Column:
        return F.transform(
            found(text, GENERATORS[kind]),
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), feature_row(kind, s).alias("x")),
        )

    return F.concat(*[proposed(k) for k in GENERATORS])


# -- boosted trees ------------------------------------------------------------------------------
@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def column(self, x: Column) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(x[self.feature] <= self.cut, self.left.column(x)).otherwise(self.right.column(x))

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.apply(x), self.right.apply(x))


@dataclass
class Model:
    trees: list[Node]
    cuts: dict[str, float]

    def score(self, x: Column) -> Column:
        out = F.lit(0.0)
        for t in self.trees:
            out = out + t.column(x)
        return out

    def apply(self, x: np.ndarray) -> np.ndarray:
        return sum((t.apply(x) for t in self.trees), np.zeros(len(x)))


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> Node:
    leaf = Node(float(SHRINK * grad.sum() / (hess.sum() + 1.0)))
    if depth == 0 or len(x) < 20:
        return leaf
    best, gain0 = (1e-6, -1, 0.0), grad.sum() ** 2 / (hess.sum() + 1)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[:-1])):
            low = x[:, f] <= cut
            if 5 <= low.sum() <= len(x) - 5:
                g, h = grad[low].sum(), hess[low].sum()
                gain = g * g / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - gain0
                if gain > best[0] + 1e-9:
                    best = (gain, f, float(cut))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Node(0.0, best[1], best[2], grow(x[low], grad[low], hess[low], depth - 1), grow(x[~low], grad[~low], hess[~low], depth - 1))


def boost(x: np.ndarray, y: np.ndarray, kinds: list[str]) -> Model:
    """Logistic boosting on two thirds; thresholds on the rest: the least score of each kind from
    which on held-out precision is PRECISION at least, and never under 0."""
    held = np.arange(len(x)) % 3 == 2
    score, trees = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x[~held], (y - p)[~held], (p * (1 - p))[~held], DEPTH)
        trees.append(tree)
        score += tree.apply(x)
    cuts = {}
    kind = np.array(kinds)
    for k in GENERATORS:
        mine = held & (kind == k)
        s, t = score[mine], y[mine]
        good = [c for c in np.unique(s) if t[s >= c].mean() >= PRECISION]
        cuts[k] = max(0.0, float(min(good))) if good else float("inf")
    return Model(trees, cuts)


def made_up(n: int = EXAMPLES, seed: int = 17) -> list[tuple[str, str, int]]:
    """(text, kind, label): sentences with one span that a generator proposes, personal or not."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 9)))
    digit = lambda k: "".join(pick("0123456789") for _ in range(k))
    hexa = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    alnum = lambda k: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    upper = lambda k: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    yes = {
        "email": lambda: (pick(["mail me ", "contact: ", "", "write to ", "adresse "]), pick([f"{word()}.{word()} at {word()} dot com", f"{word()}{digit(2)} [at] {word()} [dot] org", f"{word()} (at) {word()} (dot) net"])),
        "phone": lambda: (pick(["tel. ", "phone: ", "call ", "fax ", "Tel: ", "", "mobile "]), pick([f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"0{digit(3)} {digit(3)} {digit(3)}", f"0{digit(2)}/{digit(4)} {digit(3)}"])),
        "iban": lambda: (pick(["IBAN ", "account ", "Konto ", "", "iban: "]), f"{pick(['DE', 'FR', 'ES', 'GB'])}{digit(2)}" + pick(["", " "]).join(["", *(digit(4) for _ in range(rng.randint(4, 5)))])),
        "id": lambda: (pick(["ssn ", "SSN: ", "social ", "passport ", "dni "]), pick([f"{digit(3)}-{digit(2)}-{digit(4)}", digit(8) + pick("ABCDEFGHJK")])),
        "secret": lambda: (
            pick(["password=", "token = \"", "api_key: ", "secret=", "key=", "auth ", "pwd: ", "", "AKIA"]),
            pick([hexa(18), hexa(32), hexa(40), alnum(24), alnum(40), "AKIA" + upper(16), f"sk-{alnum(32)}", alnum(rng.randint(60, 400)), alnum(342), hexa(rng.randint(64, 1200)), f"{alnum(rng.randint(200, 500))}_{alnum(rng.randint(20, 500))}"]),
        ),
    }
    no = {
        "email": lambda: (pick(["we met ", "look ", ""]), f"{word()} at {word()} dot {word()}"[:40]),
        "phone": lambda: (pick(["pages ", "no. ", "version ", "in ", "of ", "ratio "]), pick([f"{digit(3)} {digit(3)} {digit(3)}", f"{digit(3)}.{digit(3)}.{digit(2)}", f"19{digit(2)}/{digit(3)} {digit(3)}"])),
        "iban": lambda: (pick(["model ", "part ", "code ", "ref "]), f"{upper(2)}{digit(2)}{pick(['ABCD', 'WXYZ'])}{upper(4)}"),
        "id": lambda: (pick(["part ", "item ", "version ", "of "]), pick([f"{digit(3)}-{digit(2)}-{digit(4)}", digit(8) + pick("XYZ")])),
        "secret": lambda: (
            pick(["the ", "see ", "of ", "in ", "", "path ", "and "]),
            pick([word() * 3, word() + "_" + word() + "_" + word() + "_" + word(), f"{word()}/{word()}/{word()}/{word()}", "-" * 20, digit(16), "a" * 24, word() + word() + "-" + word() + word(), (word() * 3).capitalize(), word() * rng.randint(20, 80), "/".join(word() for _ in range(rng.randint(20, 80))), "_".join(word() for _ in range(rng.randint(20, 80))), digit(rng.randint(60, 600)), pick("-_a=x9") * rng.randint(60, 900)]),
        ),
    }
    out = []
    for k in range(n):
        kind, label = list(yes)[k % 5], (k // 5) % 2
        before, span = (yes if label else no)[kind]()
        out.append((f"{word()} {word()} {before}{span}{pick(['.', ' ', ', ', chr(34), ''])} {word()} {word()}.", kind, label))
    return out


_models: dict[str, Model] = {}


def fit(spark: SparkSession) -> Model:
    """The boosted model; the same in every session, so it is kept."""
    if "model" not in _models:
        rows = made_up()
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, text string, kind string, label int").coalesce(4)
        got = df.select("n", "kind", "label", F.explode(candidates(F.col("text"))).alias("c")).where("c.kind = kind").select("n", "kind", "label", "c.start", "c.x").collect()
        got = sorted(got, key=lambda r: (r.n, r.start))
        x, y = np.array([r.x for r in got]), np.array([float(r.label) for r in got])
        _models["model"] = boost(x, y, [r.kind for r in got])
    return _models["model"]


# -- the operator -------------------------------------------------------------------------------
SPANS = "array<struct<kind:string,start:int,end:int>>"


SCORED = "struct<start:int,end:int,kind:string,score:double>"
_NONE = "named_struct('start', -1, 'end', -1, 'kind', '', 'score', double('-inf'))"


def _pending(spans: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Spans sorted by start, with each run of overlapping ones folded by ``merge`` (the one kept so far, the next)."""

    apart = lambda held, x: x["start"] >= held["end"]
    onwards = lambda held, x: F.when(apart(held, x), x).otherwise(merge(held, x))
    emit = lambda held, x: F.when(apart(held, x) & (held["start"] >= 0), F.array(held)).otherwise(F.array().cast(f"array<{SCORED}>"))
    last = lambda r: F.when(r["c"]["start"] < 0, r["out"]).otherwise(F.concat(r["out"], F.array(r["c"])))
    return bound(scan(spans, F.expr(_NONE), onwards, emit, SCORED), last)


def _free(spans: Column) -> Column:
    """Of base spans (score infinite) and proposals sorted by start, the proposals that overlap no base span.

    Forwards the furthest end of the base spans so far is carried, backwards the start of the next.
    """
    is_base = lambda x: x["score"] == float("inf")

    kept = lambda keep, x: F.when(keep, F.array(x)).otherwise(F.array().cast(f"array<{SCORED}>"))
    furthest = lambda end, x: F.when(is_base(x), F.greatest(end, x["end"])).otherwise(end)
    nearest = lambda start, x: F.when(is_base(x), x["start"]).otherwise(start)
    some = scan(spans, F.lit(0), furthest, lambda end, x: kept(is_base(x) | (x["start"] >= end), x), SCORED)["out"]
    return F.reverse(scan(F.reverse(some), F.lit(2**31 - 1), nearest, lambda start, x: kept(~is_base(x) & (x["end"] <= start), x), SCORED)["out"])


def detect(df: DataFrame, text_col: str = "text", base_col: str = "base_spans", spans_col: str = "spans") -> DataFrame:
    """All columns of ``df``, the base spans and all spans.

    Spans are arrays of (kind, start, end) in code points, end exclusive, ordered by kind as in
    KINDS, then start.  All base spans are among the spans; a proposal that overlaps any base span
    is not taken.  Proposals that overlap each other are compared in the order of their starts: the
    next one replaces the one taken last if its score is higher, else it goes.  Null texts are empty and give empty arrays; row
    count and other columns do not change; an empty table gives no rows.  A column of ``df``
    named like a result column gives way to it.
    """
    df = df.drop(*{base_col, spans_col, "__base", "__more"} - {text_col})
    model = fit(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def base(kind: str) -> Column:
        hits = F.filter(found(text, BASE[kind]), lambda x: base_ok(kind, x["m"]))
        return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    with_base = df.withColumn("__base", F.concat(*[F.when(guard(text, k), base(k)).otherwise(F.array().cast(SPANS)) for k in BASE_KINDS]))

    def chosen(c: Column) -> Column:
        cut = F.lit(float("inf"))
        for k, v in model.cuts.items():
            cut = F.when(c["kind"] == k, F.lit(v)).otherwise(cut)
        return c["score"] >= cut

    scored = F.filter(
        F.transform(candidates(text), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), model.score(c["x"]).alias("score"))),
        chosen,
    )
    inf = F.lit(float("inf"))
    as_scored = F.transform("__base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"), inf.alias("score")))
    ranked = F.element_at(
        F.transform(
            F.array(scored),
            lambda s: F.when(F.size(s) == 0, F.array().cast(SPANS)).otherwise(
                F.transform(
                    _pending(_free(F.array_sort(F.concat(as_scored, s))), lambda held, x: F.when(x["score"] > held["score"], x).otherwise(held)),
                    lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
                )
            ),
        ),
        1,
    )
    both = with_base.withColumn("__more", ranked)
    ordered = F.concat(*[F.array_sort(of_kind(F.concat("__base", "__more"), k)) for k in KINDS])
    return both.select(*df.columns, F.col("__base").alias(base_col), F.when(F.size("__more") == 0, F.col("__base")).otherwise(ordered).alias(spans_col))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def guard(text: Column, kind: str) -> Column:
    """A cheap necessary condition of each base kind."""
    mark = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    return F.contains(text, F.lit(mark)) if mark else F.lit(True)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in square brackets; overlapping spans become
    one, named after the first (of those that start together, the longest).  A text without spans (null and empty ones too) stays as it is.

    The text is cut at every CHUNK-th span first, since looking up a place takes time by its distance.
    """
    with_score = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(0.0).alias("score")))
    longer = lambda held, x: F.struct(held["start"].alias("start"), F.greatest(held["end"], x["end"]).alias("end"), F.when(x["start"] == held["start"], x["kind"]).otherwise(held["kind"]).alias("kind"), held["score"].alias("score"))

    def pieces(m: Column, k: Column) -> Column:
        low = F.when(k == 0, F.lit(0)).otherwise(F.get(m, k * CHUNK - 1)["end"])
        some = F.slice(m, k * CHUNK + 1, F.lit(CHUNK))
        part = lambda x: F.substring(text, x["low"] + 1, F.element_at(x["some"], -1)["end"] - x["low"])

        def one(x: Column, part: Column, s: Column, n: Column) -> Column:
            before = F.when(n == 0, x["low"]).otherwise(F.get(x["some"], n - 1)["end"])
            return F.concat(F.substring(part, before - x["low"] + 1, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]"))

        return bound(F.struct(low.alias("low"), some.alias("some")), lambda x: bound(part(x), lambda p: F.array_join(F.transform(x["some"], lambda s, n: one(x, p, s, n)), "")))

    def whole(m: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int"))
        tail = F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(numbers, lambda k: pieces(m, k)), ""), tail)

    return F.when(F.size(spans) > 0, bound(_pending(F.array_sort(with_score), longer), whole)).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = [F.size(of_kind(F.col("base_spans"), k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found_.select(id_col, *counts, F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
