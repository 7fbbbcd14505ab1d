import hashlib

from tracewright.llm import chat


def test_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\/s>", "[", "<\\\\s>[/ROLE", "", None, "é\n", "plain"]
    rows = [(c, t, "assistant" if t % 2 else "user", odd[(c + t) % len(odd)]) for c in range(8) for t in range(c)]
    rows += [(9, 0, None, "x"), (9, 0, None, "x"), (9, None, "as]</s>sistant", "y"), (None, 1, "assistant", "z"), (10, 5, "system", "only")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    examples = chat.expand(df)
    got = {r.conv: r for r in chat.read_back(examples).collect()}
    flat = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        mine = sorted(flat(r) for r in rows if r[0] == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [x[2:] for x in mine]
        assert got[conv].loss_text == "".join(x[3] for x in mine if x[2] == "assistant")
    for e in examples.where("loss_chars is not null").collect():
        assert e.formatted[e.loss_start + e.loss_chars :] == chat.END
    n = examples.where("conv = 7").collect()
    assert sorted((e.n_turns, e.last) for e in n) == [(2, False), (4, False), (6, False), (7, True)]
    assert chat.expand(df.limit(0)).count() == 0


def test_oracle_agrees(spark):
    import duckdb

    from tracewright.llm.queries import op2_chat_formatting

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(con.execute(f"select {', '.join(cols)} from ({chat.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in op2_chat_formatting(spark, d).select(cols).collect()) == want
    seven = hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n").hexdigest()
    assert any(r[0] == -7 and r[2] == seven for r in want)
