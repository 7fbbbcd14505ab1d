"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags, and every block with text is labelled, wherever it
stands.  Pass one decides by link density, length and stop-word density: good, bad, or undecided
where the block is too short or too poor in stop words to tell.  In pass two an undecided block
takes the label that its nearest decided neighbours in the same container agree on; where they
differ, the nearer one's, and a good one's at equal distance.

Tags and names are a prior, not a verdict on text of their own kind: a container that names itself
menu, footer, advert, form, comment and the like ("out") can make a block undecided at most, never
good; an article or main element shortens the length that a good block needs, and one
or two linked blocks in it are undecided, where a run of them is a menu; what no neighbour decides
follows the prior of its container.  The text is the good blocks of the article, without one of main,
without either of the page; where there are several articles, of whichever side has more good text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import slices
from tracewright.llm.quality import COMMON, STRIP

SHORT, LONG = 70, 200
STOP_HIGH, STOP_LOW = 0.30, 0.12
LINKS_BAD, LINKS_RUN = 0.33, 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)",
    re.S,
)
# Elements and names by kind.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "select", "button", "title", "object", "audio", "video", "canvas", "datalist"}
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUT_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "head"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
OUT_NAMES = set(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer cookie cookies notice notices consent gdpr comment comments respond replies disqus share sharing social related recommended newsletter subscribe"
    " subscription signup popup modal login form widget toolbar pagination pager masthead copyright disclaimer alert toc topbar skip".split()
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|aria-label|hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?:^|\s)(hidden)(?=\s|/|$)""", re.I)
PIECES = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")
STOP = {w for x in COMMON.values() for w in x.split()}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks that hold no others; their closing tag may lack.
LEAVES = {"p", "dt", "dd", "option", "tr", "td", "th", *HEADINGS}
#: Elements whose text is the page's own; labels do not cross the edges of containers.
CONTENT = {"article", "main"}


def _names_out(tag: str, attrs: str) -> bool:
    if tag in OUT_TAGS:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for m in NAMES.finditer(attrs):
        if m[3]:
            return True
        kind, value = m[1].lower(), m[2].strip("\"'").lower()
        if kind == "hidden" or kind == "style" and "display:none" in value.replace(" ", ""):
            return True
        if kind == "role" and value in OUT_ROLES:
            return True
        if kind in ("class", "id") and OUT_NAMES.intersection(PIECES.findall(value)):
            return True
    return False


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    kind: str  # of its container: page, main, article or out
    scope: int  # number of its container
    tag: str


class _Open:
    """Open elements that can hold blocks.  Each is (tag, container it belongs to); their numbers by tag tell
    whether a closing tag closes anything without looking through them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, int]]] = []
        self.count: dict[str, int] = {}
        self.numbers = 0
        self.paragraph: tuple[str, int] | None = None

    @property
    def scope(self) -> tuple[str, int]:
        return self.paragraph or (self.stack[-1][1] if self.stack else ("page", 0))

    def container(self, kind: str) -> tuple[str, int]:
        self.numbers += 1
        return kind, self.numbers

    def push(self, tag: str, out: bool) -> None:
        outer = self.stack[-1][1] if self.stack else ("page", 0)
        if out and outer[0] != "out":
            outer = self.container("out")
        elif tag in CONTENT and outer[0] != "out":
            outer = self.container(tag)
        self.stack.append((tag, outer))
        self.count[tag] = self.count.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        while self.count.get(tag):
            top, _ = self.stack.pop()
            self.count[top] -= 1
            if top == tag:
                break

    def leave_head(self) -> None:
        self.stack = [x for x in self.stack if x[0] != "head"]
        self.count["head"] = 0


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    opened = _Open()
    part: list[str] = []
    links, link, tag_of, at = 0, False, "", 0

    def close() -> None:
        nonlocal links
        if part:
            text = SPACE.sub(" ", entities.unescape("".join(part))).strip()
            if text:
                out.append(Block(text, links, *opened.scope, tag_of))
            part.clear()
        links = 0

    while at < len(page):
        start = page.find("<", at)
        while start >= 0 and not (m := TOKEN.match(page, start)):
            start = page.find("<", start + 1)
        text = page[at : start if start >= 0 else len(page)]
        if text:
            part.append(text)
            if link:
                links += len(SPACE.sub(" ", text).strip())
        if start < 0:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                part.append(entities_safe(m[0][9:-3]))
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not ends and not m[3].endswith("/"):
                gone = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = gone.end() if gone else len(page)
            if tag == "title":
                close()
            continue
        if tag == "a":
            link = not ends
            continue
        if tag in BLOCK:
            close()
            tag_of, opened.paragraph, link = ("" if ends else tag), None, False
        if tag == "body" and not ends:
            opened.leave_head()
        if tag in VOID:
            continue
        named = not ends and _names_out(tag, m[3])
        if tag in LEAVES:
            if named:
                opened.paragraph = opened.scope if opened.scope[0] == "out" else opened.container("out")
            continue
        if tag not in BLOCK and not named and not (ends and opened.count.get(tag)) and tag not in ("span", "ins"):
            continue
        if tag not in BLOCK and (named or ends):
            close()  # an inline element that names itself out is a block of its own
        if ends:
            opened.close(tag)
        else:
            opened.push(tag, named)
    close()
    return out


def entities_safe(text: str) -> str:
    return text.replace("&", "&amp;")


def density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(STRIP) in STOP for w in words) / len(words) if words else 0.0


def first_label(x: Block, run: int) -> str:
    """Pass one: good, bad, near (undecided, with stop words) or short (undecided).  ``run``: how many linked blocks stand together."""
    content = x.kind in CONTENT
    if x.links > LINKS_BAD * len(x.text):
        return "short" if content and run < LINKS_RUN else "bad"
    if not content and "\u00a9" in x.text:
        return "bad"
    stop = density(x.text)
    if len(x.text) < SHORT or x.tag in HEADINGS:
        return "short"
    if x.kind == "out":
        return "near" if stop >= STOP_HIGH else "bad"
    if stop >= STOP_HIGH:
        return "good" if content or len(x.text) >= LONG else "near"
    if stop >= STOP_LOW:
        return "good" if len(x.text) >= (LONG if content else 2 * LONG) else "near"
    return "short" if content else "bad"


def _runs(found: list[Block]) -> list[int]:
    """For each block how many linked blocks of its container stand together with it; 0 for one that is not linked."""
    out, at = [0] * len(found), 0
    while at < len(found):
        stop = at
        while stop < len(found) and found[stop].scope == found[at].scope and found[stop].links > LINKS_BAD * len(found[stop].text):
            stop += 1
        out[at:stop] = [stop - at] * (stop - at)
        at = max(stop, at + 1)
    return out


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is good after pass two: ``near`` blocks inherit first, then ``short`` ones."""
    first = [first_label(x, n) for x, n in zip(found, _runs(found), strict=True)]
    scope = [x.scope for x in found]
    for kind in ("near", "short"):
        before, after = _neighbours(first, scope, 1), _neighbours(first, scope, -1)
        new = {k: inherit(before[k], after[k], found[k].kind, kind) for k, x in enumerate(first) if x == kind}
        for k, x in new.items():
            first[k] = x
    return [x == "good" for x in first]


def inherit(before: tuple[int, str], after: tuple[int, str], container: str, kind: str) -> str:
    """Label of an undecided block from the (distance, label) of its decided neighbours, the label empty where there is none."""
    (a, left), (b, right) = before, after
    if not left and not right:
        return "good" if container in CONTENT or (container == "page" and kind == "near") else "bad"
    if left == right or not right or not left:
        return left or right
    return left if a < b else right if b < a else "good"


def _neighbours(first: list[str], scope: list[int], step: int) -> list[tuple[int, str]]:
    """Distance and label of the nearest decided block on one side within the same scope."""
    out: list[tuple[int, str]] = [(len(first) + 1, "")] * len(first)
    last: dict[int, tuple[int, str]] = {}
    order = range(len(first)) if step > 0 else range(len(first) - 1, -1, -1)
    for k in order:
        if scope[k] in last:
            j, label = last[scope[k]]
            out[k] = (abs(k - j), label)
        if first[k] in ("good", "bad"):
            last[scope[k]] = (k, first[k])
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    good = [x for x, keep in zip(found, labels(found), strict=True) if keep]
    held = {kind: [x for x in good if x.kind == kind] for kind in ("article", "main", "page")}
    first = next((kind for kind in held if held[kind]), "page")
    if first == "article" and len({x.scope for x in held["article"]}) > 1:  # cards beside a story, where the story is longer
        first = max(held, key=lambda kind: sum(len(x.text) for x in held[kind]))
    return " ".join(x.text for x in held[first])


def extract(df: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url"), text_col: str = "text") -> DataFrame:
    """The ``carry`` columns, the main text and its code points (``n_chars``), one row per page.

    Null, empty and text-free pages give an empty text; repeated rows are kept; an empty table
    gives no rows.  A carried column named like a result column gives way to it.
    """
    carry = tuple(c for c in carry if c not in (text_col, "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [main_text(x) for x in part.column("__html").to_pylist()]
            cols = [part.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*carry, text_col, "n_chars"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(*carry, F.col(html_col).alias("__html")).mapInArrow(run, f"{kinds}, `{text_col}` string, n_chars long")
