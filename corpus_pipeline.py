"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Language identification drops documents without a language, exact dedup keeps one of equal texts, near dedup
one of each linked group, personal data are replaced by their kind, and best-fit packing places what is left.
All stages but the last return the columns of ``documents``. A row is known by its doc_id, null or not, and the hash
of its text, so rows that repeat a doc_id with other texts are judged each by its own; rows that repeat both share
their fate. A document leaves a dedup stage through a bitmap filter and an anti join of the few rows that it
names, so the text of kept documents is not shuffled. Near duplicates share 80 % of their five-word shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspark.llm.common import drop_stored, lower_ascii, stored, table, without
from quarryspark.llm.exact_dedup import exact_dedup
from quarryspark.llm.language_id import of_known_language
from quarryspark.llm.minhash import near_groups
from quarryspark.llm.packing import pack
from quarryspark.llm.pii import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go."""
    return of_known_language(docs)


SHINGLE = 5  # words


def _without(docs: DataFrame, gone: DataFrame, mark: Column) -> DataFrame:
    """``docs`` but the rows of ``gone`` (doc_id, mark)."""
    gone = stored(gone, "pipeline-gone")
    return without(docs, gone, gone.count(), mark).select(*docs.columns)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the largest doc_id."""
    gone = exact_dedup(docs).where("not kept").select("doc_id", F.col("text_sha256").alias("mark"))
    return _without(docs, gone, F.sha2(lower_ascii(_text()), 256))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id."""
    return _without(docs, near_groups(docs, SHINGLE).where("not first").select("doc_id", "mark"), F.xxhash64(_text()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with [KIND] in place of personal data, and n_chars of the new text."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: its document, its tokens' checksum, its sequence and its place there."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicate_groups),
    ("pii", personal_data),
    ("packing", packing),
]

#: Models and tokenizers have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
