"""Registered queries of the llm operators, with their SQL where plain SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import bpe, chat, decontaminate, fingerprints, licenses, merkle, minhash, negatives, pii, secrets, substring, toxicity, urls
from pathweave.llm.license_forms import FORMS
from pathweave.llm.tables import documents, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(table(spark, sf_dir, "documents")), licenses.template_table(spark), forms=licenses.TEMPLATES + FORMS)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(table(spark, sf_dir, "documents")), tokenizer("byte_bpe_50k.json"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(table(spark, sf_dir, "documents")), tokenizer("byte_bpe_50k.tiktoken"), bpe.PATTERN)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).drop("lower")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(table(spark, sf_dir, "documents")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_licenses": op2_licenses,
    "op3_toxicity": op3_toxicity,
    "op4_substring": op4_substring,
    "op5_bpe": op5_bpe,
    "op6_secrets": op6_secrets,
    "op7_urls": op7_urls,
    "op8_fingerprints": op8_fingerprints,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
    "op11_pii": op11_pii,
    "op12_merkle": op12_merkle,
    "op13_negatives": op13_negatives,
}

SQL: dict[str, str] = {"op2_licenses": licenses.sql(), "op7_urls": urls.sql(), "op9_chat": chat.sql(), "op13_negatives": negatives.sql()}
