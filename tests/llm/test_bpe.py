import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    out = ["", "Hello  Wörld's 123 !!'s <|endoftext|> x<|startoftext|>y", "  ", "a\x1cb\u0085c", "é ́x İSTANBUL ΣΑΣ ﬁ", "\U0001f600\U0001f1e9 � ​"]
    out += ["".join(rng.choice("abcdeinothr") for _ in range(n)) for n in (255, 257, 1025, 3000, 20_000)]
    out += ["".join(rng.choice("!?'#s.-") for _ in range(n)) for n in (1025, 9000)]
    out += ["a" * 5000 + "<|endoftext|>" + "!" * 3001 + "12" * 600 + "é" * 2000 + " " + "the" * 900]
    out += [" ".join("".join(rng.choice("thaeinorsdlÉü'1!") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (50, 20_000)]
    out += ["é Ã© ü Ã¼ Ü, The the THE, the' they're, x's don't ÿ! ß. ×a÷ aªb µm", "ÀÉÎ, Ã\x80 naïve... Straße;", "a\u0301b e\u0308, é\u0301", "A" * 255 + ", " + "É" * 300 + "!"]
    return out


def words():
    """Words of every kind around the short way: letters, marks behind, before and between them."""
    rng = random.Random(8)
    letters, marks = "abethinXYZéÉßÿÃ¼©þØ", ".,;:!?'\"-()<|>&%"
    for _ in range(3000):
        head = "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
        tail = "".join(rng.choice(marks) for _ in range(rng.randint(0, 3)))
        yield rng.choice([head + tail, tail + head, head + tail + head, tail, head])


def test_words_equal_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)  # generations change often
    coder, all_words = bpe.WordBpe(PATH), list(words())
    for at in range(0, len(all_words), 300):
        text = " ".join(all_words[at : at + 300])
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.texts(pa.array([None, text, ""])).to_pylist() == [[], want, []]
        assert len(coder.cache) <= 50 and len(coder.older) <= 50


def test_id_named_like_a_result(spark):
    df = spark.createDataFrame([(1, "a b", "seq")], "n_tokens long, text string, kind string")
    assert bpe.encode_decode(df, PATH, "n_tokens").columns == ["n_tokens", "ids", "decoded"]
    long = spark.createDataFrame([("k", "word " * 20_000)], "key string, text string")
    assert [tuple(r) for r in bpe.encode_decode(long, PATH, "key", want=("n_tokens",)).collect()] == [("k", 20_000)]


def test_equals_library(library):
    coder = bpe.WordBpe(PATH)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = coder.text(text)
        import numpy as np

        assert np.frombuffer(ids, "<i4").tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_join_is_exact_at_any_cut(library):
    coder, rng = bpe.WordBpe(PATH), random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice("thaeinors") for _ in range(rng.randint(2, 60)))
        cut = rng.randint(1, len(text) - 1)
        left, right = coder.run_ids(text[:cut], False), coder.run_ids(text[cut:], True)
        assert coder.join(left, right, True) == coder.run_ids(text, True)


def test_operator(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(1, "again again", "x"), (1, "again again", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_decode(df, PATH).collect()
    assert len(got) == len(rows)
    seen = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, list(r.ids), r.decoded) for r in got)
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k if k is not None else -1, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert seen == sorted(want)
    assert bpe.encode_decode(df.where(F.lit(False)), PATH).count() == 0
