"""BPE encoding and decoding with tree concatenation of long unsplit text.

White space always ends a pre-token of the word-end vocabulary, so a text is encoded word by
word: the texts of a batch are cut and their different words numbered by Arrow, each different
word is encoded once, and the ids of the texts are taken by number.  Results of short words are
kept from batch to batch and task to task, in two generations of ``CACHE`` words: a full one
replaces the older, so words in use stay.  A word longer than ``LONG_WORD`` is cut into
pre-tokens, and a pre-token longer than ``LEAF`` (one unbroken run of letters or symbols) is
cut into halves again and again; the leaves are encoded on their own, then joined pairwise up
the tree: the tokens around a join are encoded again in a growing window until its first and
last tokens agree with what stands on either side.  Two token sequences whose neighbours agree
everywhere are the encoding of the whole, because a BPE encoding is canonical exactly if each
adjacent pair of its tokens is the encoding of their joint text.

Texts over ``SPREAD`` characters have their leaves and words encoded by many tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import slices

LONG_WORD = 1024
LEAF = 256
SPREAD = 65_536
BLOCK = 16_384
CACHE = 50_000
# Letters that no normal form changes next to each other, and words of them with ASCII marks behind (an apostrophe may begin a suffix of letters).
LETTERS = "".join(chr(c) for c in range(0x100) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA))
PLAIN = re.compile(rf"([{LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)")


class WordBpe:
    """Encoder for a word-end BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.model = path, self.whole.model
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.text_of = {i: t for t, i in spec["model"]["vocab"].items()}
        self.specials = {t["id"]: t["content"] for t in spec["added_tokens"]}
        names = self.text_of | self.specials
        self.names = pa.array([names[i] for i in range(len(names))])
        # a letter as the model sees it: lower case over the byte alphabet
        self.mapped = {ord(c): self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(c))[0][0] for c in LETTERS}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def inner(self):
        """The bare model inside a run; built only where a text has a long run.

        Inside a run no symbol carries the word end; merges that need it cannot occur there.
        """
        from tokenizers.models import BPE

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        return BPE(model["vocab"], [m for m in merges if not m[1].endswith(self.suffix)])

    # -- one run, cut into leaves and joined up the tree ------------------------------------
    def run_ids(self, text: str, last: bool) -> list[int]:
        return [t.id for t in (self.model if last else self.inner).tokenize(text)] if text else []

    def surface(self, ids: list[int]) -> str:
        out = "".join(self.text_of[i] for i in ids)
        return out.removesuffix(self.suffix)

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Encoding of the joint text of two encoded neighbours; ``last``: ``right`` ends the run."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            ends = last and j == len(right)
            window = self.run_ids(self.surface(left[-i:]) + self.surface(right[:j]), ends)
            good_left = i == len(left) or self.agree(left[-i - 1], window[0], ends and len(window) == 1)
            good_right = j == len(right) or self.agree(window[-1], right[j], last and j + 1 == len(right))
            if good_left and good_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if good_left else 2 * i), (j if good_right else 2 * j)

    def agree(self, a: int, b: int, last: bool) -> bool:
        return self.run_ids(self.surface([a]) + self.surface([b]), last) == [a, b]

    def tree(self, leaves: list[list[int]], last: bool) -> list[int]:
        while len(leaves) > 1:
            joined = [
                self.join(leaves[k], leaves[k + 1], last and k + 2 == len(leaves))
                for k in range(0, len(leaves) - 1, 2)
            ]
            leaves = joined + leaves[len(leaves) // 2 * 2 :]
        return leaves[0] if leaves else []

    # -- words ------------------------------------------------------------------------------
    def parts(self, word: str) -> list[tuple[str, bool]]:
        """Pieces of a long word as (text, is a mapped run): special tokens and short pre-tokens
        as they are, long pre-tokens as runs over the model's byte alphabet."""
        out: list[tuple[str, bool]] = []
        rest = [word]
        for content in self.specials.values():
            rest = [y for x in rest for y in _between(x, content)]
        for piece in rest:
            if piece in self.specials.values():
                out.append((piece, False))
                continue
            plain = self.whole.normalizer.normalize_str(piece)
            for run, _ in self.whole.pre_tokenizer.pre_tokenize_str(plain):
                out.append((run, True))
        return out

    def encode_parts(self, parts: list[tuple[str, bool]]) -> list[int]:
        out: list[int] = []
        for text, run in parts:
            if not run:
                out += self.whole.encode(text, add_special_tokens=False).ids
            elif len(text) <= LEAF:
                out += self.run_ids(text, True)
            else:
                cut = halves(text)
                out += self.tree([self.run_ids(x, n == len(cut) - 1) for n, x in enumerate(cut)], True)
        return out

    def word(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers.

        Letters alone are one pre-token and marks after them another, whatever stands before or
        after, so such words go to the bare model; all others take the library's whole way.
        """
        if (plain := PLAIN.fullmatch(word)) and len(word) <= LEAF:
            return self.run(plain[1].translate(self.mapped)) + (self.run(plain[2]) if plain[2] else b"")
        found = self.older.get(word)
        if found is None:
            if len(word) > LONG_WORD:
                ids = self.encode_parts(self.parts(word))
            else:
                ids = self.whole.encode(word, add_special_tokens=False).ids
            found = np.array(ids, "<i4").tobytes()
        return self.keep(word, found)

    def run(self, run: str) -> bytes:
        """Ids of a short pre-token over the byte alphabet."""
        key = run if run.isascii() else " " + run  # as a word the same characters would be other bytes
        found = self.cache.get(key)
        if found is None:
            found = self.older.get(key)
            found = self.keep(key, np.array(self.run_ids(run, True), "<i4").tobytes() if found is None else found)
        return found

    def keep(self, word: str, found: bytes) -> bytes:
        if len(word) <= 64:
            if len(self.cache) >= CACHE:
                self.cache, self.older = {}, self.cache
            self.cache[word] = found
        return found

    def texts(self, column: pa.Array) -> pa.ListArray:
        """Ids of whole texts; none of a null."""
        words = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))
        coded = words.flatten().dictionary_encode()
        found = []
        for w in coded.dictionary.to_pylist():
            ids = self.cache.get(w)  # the cache itself may change with every word
            found.append(self.word(w) if ids is None else ids)
        ends = np.cumsum([0, *map(len, found)]) // 4
        kinds = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
        each = kinds.take(coded.indices)
        starts = words.offsets.to_numpy() - words.offsets[0].as_py()
        return pa.ListArray.from_arrays(pa.array(each.offsets.to_numpy()[starts] - each.offsets[0].as_py(), pa.int32()), each.flatten())

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """The library's decoding of this file: it names no decoder, so tokens are joined by a space."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")

    def text(self, text: str | None) -> tuple[bytes, str]:
        """Ids of a whole text as little-endian 32-bit integers, and their decoded text."""
        ids = self.texts(pa.array([text], pa.string()))
        return ids.flatten().to_numpy().astype("<i4").tobytes(), self.decoded(ids)[0].as_py()


def _between(text: str, content: str) -> list[str]:
    out = []
    for k, x in enumerate(text.split(content)):
        out += ([content] if k else []) + ([x] if x else [])
    return out


def split(text: str) -> list[str]:
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the tokenizer
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        return [w for w in text.split(" ") if w]
    return text.split()


def halves(text: str) -> list[str]:
    """Leaves of the tree of halves; their number is a power of two and none is over LEAF."""
    out = [text]
    while len(out[0]) > LEAF:
        out = [y for x in out for y in (x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :])]
    return out


_encoders: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]


def _rows(path: str, want: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in slices(batches):
            found = bpe.texts(part.column("__text"))
            yield pa.RecordBatch.from_arrays([part.column("__id"), *_columns(bpe, found, want)], names=["__id", *want])

    return run


def _columns(bpe: WordBpe, found: pa.ListArray, want: tuple[str, ...]) -> list[pa.Array]:
    made = {"n_tokens": lambda: pc.list_value_length(found).cast(pa.int64()), "ids": lambda: found, "decoded": lambda: bpe.decoded(found)}
    return [made[w]() for w in want]


TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string"}


def encode_decode(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    want: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``id_col`` and the columns of ``want`` among n_tokens (long), ids (array<int>) and
    decoded (string); one row per input row, repeated rows and ids included.  Null and empty
    texts give 0 tokens, an empty array and an empty string; null ids are carried; an empty table
    gives no rows; other columns of the input are not carried.  Where ``id_col`` has the name of a
    result column, that result is left out.  ``tokenizer_path`` must be readable on every
    executor.  One row's text, ids and decoded text must fit a task.
    """
    want = tuple(w for w in TYPES if w in want and w != id_col)
    schema = f"__id {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{w} {TYPES[w]}" for w in want)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    short = rows.where(F.coalesce(F.length("__text"), F.lit(0)) <= SPREAD)
    long = rows.where(F.length("__text") > SPREAD)
    done = short.mapInArrow(_rows(tokenizer_path, want), schema)
    return done.unionByName(_spread(long, tokenizer_path, want, schema)).withColumnRenamed("__id", id_col)


def _spread(long: DataFrame, path: str, want: tuple[str, ...], schema: str) -> DataFrame:
    """The same for very long texts: blocks and leaves are encoded by many tasks, then joined per text."""

    def cut(batches):
        bpe, place = encoder(path), None
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        n = 0
        for part in slices(batches, 16):
            for ident, text in zip(part.column("__id").to_pylist(), part.column("__text").to_pylist(), strict=True):
                key = hashlib.sha256(f"{place}:{n}:{ident}".encode()).digest()[:16]
                n += 1
                rows = [(seq, *x) for seq, x in enumerate(pieces(bpe, text))]
                for at in range(0, len(rows), 256):
                    some = rows[at : at + 256]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": [key] * len(some),
                            "__id": pa.array([ident] * len(some), part.schema.field("__id").type),
                            "seq": pa.array([x[0] for x in some], pa.int32()),
                            "kind": [x[1] for x in some],
                            "piece": [x[2] for x in some],
                        }
                    )

    def encode(batches):
        bpe = encoder(path)
        for part in slices(batches, 64):
            kinds, texts = part.column("kind").to_pylist(), part.column("piece").to_pylist()
            ids = [bpe.text(x)[0] if kind == "text" else _one(bpe, kind, x) for kind, x in zip(kinds, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("__id"), part.column("seq"), part.column("kind"), pa.array(ids, pa.binary())],
                names=["key", "__id", "seq", "kind", "ids"],
            )

    def gather(table: pa.Table) -> pa.Table:
        bpe = encoder(path)
        rows = sorted(zip(table.column("seq").to_pylist(), table.column("kind").to_pylist(), table.column("ids").to_pylist(), strict=True))
        out: list[np.ndarray] = []
        leaves: list[list[int]] = []
        for _, kind, ids in rows:
            one = np.frombuffer(ids, "<i4")
            if kind in ("inner", "last"):
                leaves.append(one.tolist())
                if kind == "last":
                    out.append(np.array(bpe.tree(leaves, True), "<i4"))
                    leaves = []
            else:
                out.append(one)
        flat = np.concatenate(out) if out else np.zeros(0, "<i4")
        found = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
        ident = pa.array(table.column("__id").to_pylist()[:1], table.schema.field("__id").type)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([ident, *_columns(bpe, found, want)], names=["__id", *want])])

    carried = f"__id {long.schema['__id'].dataType.simpleString()}"
    leaves = long.mapInArrow(cut, f"key binary, {carried}, seq int, kind string, piece string")
    leaves = leaves.repartition("key", "seq")
    coded = leaves.mapInArrow(encode, f"key binary, {carried}, seq int, kind string, ids binary")
    return coded.groupBy("key").applyInArrow(gather, schema)


def _one(bpe: WordBpe, kind: str, piece: str) -> bytes:
    ids = bpe.whole.encode(piece, add_special_tokens=False).ids if kind == "special" else bpe.run_ids(piece, kind != "inner")
    return np.array(ids, "<i4").tobytes()


def pieces(bpe: WordBpe, text: str) -> Iterator[tuple[str, str]]:
    """Blocks of whole words ('text'), and of long words their special tokens ('special'), short
    pre-tokens ('run') and the leaves of long ones ('inner', the final one 'last')."""
    block: list[str] = []
    size = 0
    for word in split(text):
        if len(word) > LONG_WORD:
            if block:
                yield "text", " ".join(block)
                block, size = [], 0
            for part, run in bpe.parts(word):
                if not run:
                    yield "special", part
                elif len(part) <= LEAF:
                    yield "run", part
                else:
                    cut = halves(part)
                    yield from (("last" if n == len(cut) - 1 else "inner", x) for n, x in enumerate(cut))
            continue
        block.append(word)
        size += len(word) + 1
        if size >= BLOCK:
            yield "text", " ".join(block)
            block, size = [], 0
    if block:
        yield "text", " ".join(block)
