import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathweave.llm import bpe, queries
from pathweave.llm.tables import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(rows):
    out = []
    for doc, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        out.append((doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert rows(queries.op5_bpe(spark, sf_dir)) == expected(docs)


def test_odd_rows(spark, edge_docs, no_docs, make_docs):
    odd = make_docs([(1, "<|endoftext|>"), (2, "a<|endoftext|> b<|endoftext|><|endoftext|>"), (3, "\n\n \t x    y"), (4, "ſ 🤖🤖 é"), (5, "don't WE'LL 12345")])
    assert rows(bpe.digests(odd, PATH)) == expected(odd.collect())
    edge = documents(edge_docs)
    assert rows(bpe.digests(edge, PATH)) == expected(edge.collect())
    assert rows(bpe.digests(no_docs, PATH)) == []
    assert bpe.encode(edge_docs, PATH).count() == edge_docs.count()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    vocab = bpe.vocabulary(PATH)
    ids = vocab.encode([text])[0]
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert vocab.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_greedy_words_are_corrected():
    vocab = bpe.Vocabulary(PATH)
    words = ["unbelievably", "thethethethe", "aaaaaaaaaaaaaaaa", "Straßenbahnhaltestelle", "q" * 5000]
    wrong = [w for w in words if vocab.propose(w.encode()) != vocab.merge(w.encode())]
    assert wrong and [i.tolist() for i in vocab.encode(words)] == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]


def test_memory_is_thinned(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    vocab = bpe.Vocabulary(PATH)
    for text in ("one two three four five six seven", "eight nine <|endoftext|> ten", "one two"):
        assert vocab.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_pair_verdicts_and_rounds_equal_merging():
    vocab = bpe.Vocabulary(PATH)
    assert vocab.ordered
    rng = np.random.default_rng(5)
    common = np.array([i for i, t in vocab.tokens.items() if len(t) <= 3 and i not in vocab.special.values()])
    left, right = (np.concatenate([rng.integers(0, 50_000, 3000), rng.choice(common, 3000)]) for _ in range(2))
    reached = vocab.reachable(left) & vocab.reachable(right)
    left, right = left[reached], right[reached]
    merged = [vocab.merge(vocab.tokens[a] + vocab.tokens[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist())]
    assert vocab.compatible(left, right).tolist() == merged and 0 < sum(merged) < len(merged)
    vocab.ordered = False
    assert vocab.compatible(left[:200], right[:200]).tolist() == merged[:200]
    words = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in range(1, 130)]
    assert vocab.merged(words) == [vocab.merge(w) for w in words]
    flat, counts = vocab.propose_all(words)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [vocab.propose(w) for w in words]
