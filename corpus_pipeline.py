"""A cleaned and tokenised corpus: toxicity, near-dedup, decontamination, secrets, tokens.

STAGES run in order; each reads what the one before wrote, all of it. The first four return the columns of ``documents``; the last
returns one row per document with its tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import bpe, decontaminate, minhash, secrets, toxicity
from pathweave.llm.queries import tokenizer
from pathweave.llm.tables import table, written

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays below TOXIC_FROM."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies."""
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    found = decontaminate.with_passages(docs, table(spark, sf_dir, "benchmark"), column="__passages")
    return found.filter(F.col("__passages.n_hit") == 0).drop("__passages")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text."""
    out = secrets.redact(docs, tokenizer("byte_bpe_50k.tiktoken"), bpe.PATTERN)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer("byte_bpe_50k.json"), decoded=True)
    return bpe.hashed(encoded, "doc_id", "lang", "source")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", hide_secrets),
    ("bpe", tokenize),
]

#: Trees, sketches and tokens are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
