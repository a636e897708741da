"""Corpus pipeline: language ID, near-dedup, benchmark decontamination, secret
redaction, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet into the shared folder and reads it back as the next one's input.
All but the last return the columns of ``docs``, whatever they are besides doc_id,
text, lang, source and n_chars. Empty tables pass through as empty tables; null and
empty texts are rejected by the first stage; rows with a null id are kept by every
stage that doesn't reject their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import stage
from furrow.llm.decontaminate import drop_contaminated
from furrow.llm.language import fit_identifier, keep_identified
from furrow.llm.minhash import keep_representatives
from furrow.llm.mixing import mix_sources
from furrow.llm.secrets import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages of the labelled documents; documents that the models reject
    (no letters, or unlike every learned language) go."""
    return keep_identified(docs, fit_identifier(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group stays."""
    return keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; no document goes."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes words from, with size, source_size, target and taken."""
    return mix_sources(docs).where(F.col("taken") > 0)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("redact", redact), ("mix", mix)]

# Language models and signatures are not SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
