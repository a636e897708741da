"""Registered queries of the document operators: each reads whole tables with
production parameters and returns the operator's full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import collocations as phrases
from furrow.llm import decontaminate, minhash, mixing, substring
from furrow.llm.conversations import damage, repair_conversations
from furrow.llm.decontaminate import contamination
from furrow.llm.fingerprint import fingerprints
from furrow.llm.language import identify_documents
from furrow.llm.minhash import near_duplicates
from furrow.llm.mixing import mix_sources
from furrow.llm.passages import repeated_passages
from furrow.llm.quality import fit_quality, score_quality
from furrow.llm.secrets import scan_secrets
from furrow.llm.substring import remove_repeats
from furrow.llm.token_counts import token_counts
from furrow.llm.token_files import digest_token_files, write_token_files

OVER_LIMIT = 1024
QUALITY_BOUND = 0.3
END_OF_TEXT = 50256     # the special token of byte_bpe_50k
END_ID = 2              # follows each document's ids in token files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: bytes and byte-level BPE tokens of every whole text."""
    counts = token_counts(_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN, {"<|endoftext|>": END_OF_TEXT})
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)


def _crc32_rest(column: str, of: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: quality score of every whole text."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(_crc32_rest("doc_id", 5) != 0))
    return score_quality(docs, model).select(
        "doc_id", F.coalesce(_crc32_rest("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= QUALITY_BOUND, 1).otherwise(0).alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: language of every whole text."""
    return identify_documents(_table(spark, sf_dir, "documents"), _crc32_rest("doc_id", 3) == 1)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: fingerprints of every whole text and its edited text."""
    return fingerprints(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: bytes of every whole text that repeat earlier 100-byte strings."""
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: benchmark windows in every whole text."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: near-duplicate components of all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: near-duplicate passages between documents."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: words that the mix takes from every document."""
    return mix_sources(_table(spark, sf_dir, "documents"), keep_text=False)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: secret spans of every whole text."""
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: best phrases of each language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: faults, cheapest edits and repaired text of every damaged conversation."""
    conversations = _table(spark, sf_dir, "conversations")
    return repair_conversations(damage(conversations), conversations)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: ids of every whole text, written to token files and read back."""
    index = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return digest_token_files(index).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_fingerprints": op4_fingerprints,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_minhash": op7_minhash,
    "op8_passages": op8_passages,
    "op9_secret_scan": op9_secret_scan,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_conversations": op12_conversations,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {
    "op5_substring_dedup": substring.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op7_minhash": minhash.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_collocations": phrases.ORACLE,
}
