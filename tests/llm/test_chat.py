from pathweave.llm import chat, queries


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, speaker string, part string")


def rendered(df):
    return {(r.conv_id, r.speaker, r.part): r for r in df.collect()}


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 2, "bob", "b"), (1, 1, "ann", "hello <|end|>"), (1, 0, "system", "be nice"), (1, 3, "ann", None), (2, 0, "system", "alone")]
    got = rendered(chat.rotate(turns(spark, rows)))
    assert set(got) == {(1, "ann", 0), (1, "bob", 0)}
    ann = got[1, "ann", 0]
    assert ann.rendered == "<|system|>\nbe nice<|end|>\n<|assistant|>\nhello < |end|><|end|>\n<|user name=bob|>\nb<|end|>\n<|assistant|>\n<|end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in ann.mask.split(",")]
    assert [ann.rendered[a:b] for a, b in spans] == ["hello < |end|><|end|>", "<|end|>"] and ann.n_masked == sum(b - a for a, b in spans)
    assert [got[1, "bob", 0].rendered[a:b] for a, b in [map(int, got[1, "bob", 0].mask.split(":"))]] == ["b<|end|>"]


def test_odd_rows(spark):
    rows = [(None, 0, "u", "no id"), (None, 1, None, "no role"), (3, None, "u", "late"), (3, 0, "u", "early"), (4, 0, "u", "twice"), (4, 0, "u", "twice"), (5, 300, "a", ""), (5, 1, "b", "é" * 3000)]
    got = rendered(chat.rotate(turns(spark, rows)))
    assert got[None, "unknown", 0].rendered.startswith("<|user name=u|>\nno id")
    assert sum(1 for k in got if k[0] == 3) == 2 and got[4, "u", 0].n_turns == 2
    assert {k for k in got if k[0] == 5} == {(5, "a", 0), (5, "a", 1), (5, "b", 0), (5, "b", 1)} and got[5, "b", 1].mask == ""
    assert rendered(chat.rotate(turns(spark, []))) == {}


def test_a_long_conversation_is_spread(spark):
    rows = [(9, i, "ab"[i % 2], f"t{i}") for i in range(1000)]
    got = rendered(chat.rotate(turns(spark, rows), part=100))
    whole = "".join(got[9, "a", p].rendered for p in range(10))
    assert len(got) == 20 and whole.count("<|assistant|>") == 500 and whole.index("t0<") < whole.index("t999<")


def test_no_python_runs(spark, sf_dir):
    text = queries.op9_chat(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
