import re

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from pathweave.llm import secrets, toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_minhash import brute as groups
from tests.llm.test_secrets import base_spans


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "bpe"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in entry.queries() if re.match(r"op\d", n)} == {f"op{i}" for i in range(1, 14)}


def test_run_equals_brute_force(spark):
    """Scores are the operator's own (tested by held-out accuracy); everything after them is recomputed row by row."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.scores(docs, labels).filter("predicted = 1").collect()}
    assert toxic
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    root = groups(list(left.items()))
    left = {i: t for i, t in left.items() if root[i] == i}
    hit = {r[0] for r in contaminated(list(left.items()), [(r.item_id, r.text) for r in bench.collect()]) if r[5]}
    assert hit
    left = {i: t for i, t in left.items() if i not in hit}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(left)
    random = {r.doc_id for r in secrets.report(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), corpus_pipeline.bpe.PATTERN).filter("n_random > 0").collect()}
    for i, text in left.items():
        if i in random:
            continue
        out, at = "", 0
        for a, _, b in base_spans(text):
            if a >= at:
                out += text[at:a] + "[SECRET]" * (a > at or not out)
            at = max(at, b)
        assert got[i] == len(library.encode(out + text[at:], add_special_tokens=False).ids), i


def test_stages_keep_columns_and_odd_rows(spark, edge_docs, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = edge_docs.selectExpr("*", "'en' as lang", "'src0' as source", "cast(length(text) as bigint) as n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.tokenize(spark, docs, sf_dir).count() == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_hidden_secrets_change_the_length(spark):
    docs = spark.createDataFrame([(1, "token = \"0123456789abcdef0123456789abcdef\" x", 42)], "doc_id long, text string, n_chars int")
    row = corpus_pipeline.hide_secrets(spark, docs, "").first()
    assert row.text == '[SECRET]" x' and row.n_chars == len(row.text)
