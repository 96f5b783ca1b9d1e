import random
import zlib

from pathweave.llm import queries, toxicity


def test_held_out_accuracy(spark):
    """Labels are learnt from two thirds of the rows; the others are predicted."""
    sf_dir = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    toxic = [got[r.doc_id].predicted for r in labels if r.toxic and got[r.doc_id].held_out]
    clean = [got[r.doc_id].predicted for r in labels if not r.toxic and got[r.doc_id].held_out]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def corpus(n=400):
    rng = random.Random(1)
    words = [f"wort{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(40)]
        if i % 5 == 0:
            for _ in range(3):
                text[rng.randrange(40)] = "grumble" + rng.choice("abcdef")
        docs.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(i % 5 == 0)))
    return docs, labels


def test_word_beginnings_are_learnt_and_odd_rows_pass(spark, make_docs):
    docs, labels = corpus()
    docs += [(1000, None), (1001, ""), (1002, "x" * 100_000), (1003, "grumblez grumbley grumblex " + "wort1 " * 30), (3, docs[3][1]), (None, "wort1 wort2")]
    labels = spark.createDataFrame([*labels, (2, None), (None, 1), (5555, 1), (4, 0), (4, 0)], "doc_id long, toxic int")
    out = toxicity.scores(make_docs(docs), labels).collect()
    assert len(out) == len(docs)
    score = {r.doc_id: r.predicted for r in out}
    assert all(score[i] == (i % 5 == 0) for i in range(400)) and score[1003] == 1 and score[1000] == score[1001] == score[1002] == score[None] == 0
    kept = toxicity.keep_clean(make_docs(docs).selectExpr("*", "1 as score", "'a' as tox", "2 as prediction"), labels)
    assert kept.columns == ["doc_id", "text", "score", "tox", "prediction"] and kept.count() == len(docs) - 81


def test_without_labels_or_documents(spark, make_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scores(make_docs([(1, "a"), (2, None)]), none).collect()] == [0.0, 0.0]
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scores(make_docs([(1, "a"), (2, "b"), (3, "c")]), ones).collect()} == {1.0}
    assert toxicity.scores(no_docs, ones).count() == 0


def test_learning_is_bounded(spark, make_docs):
    docs, labels = corpus()
    rows = toxicity.sample(toxicity.documents(make_docs(docs)), spark.createDataFrame(labels, "doc_id long, toxic int"), 50).collect()
    assert 20 <= len(rows) <= 50 and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in rows)
