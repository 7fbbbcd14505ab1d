from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from tracewright.llm import lengths

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_brute_force(spark):
    texts = ["a b c", "a b c", None, "", "word " * 1500, "x " * 3000, "<|endoftext|>", "ab! 12"] + ["t " * k for k in range(40)]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, n_docs int")
    library = Tokenizer.from_file(PATH)
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    limits = lengths.context_limits(lengths.histogram(df, PATH))
    got = {r.n_tokens: r for r in limits.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(n)
    for k, r in got.items():
        assert r.docs_over == sum(x > k for x in n) and r.tokens_over == sum(x for x in n if x > k)
        assert r.truncated_total == sum(min(x, k) for x in n)
        assert (r.total_docs, r.total_tokens) == (len(n), sum(n))
        assert abs(r.share_within - sum(x <= k for x in n) / len(n)) < 1e-9
    assert lengths.quantile(limits, 0.5).first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]
    assert lengths.truncated_total(limits, 2000).first()[0] == sum(min(x, 2000) for x in n)
    assert lengths.context_limits(lengths.histogram(df.limit(0), PATH)).count() == 0
