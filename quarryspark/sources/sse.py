"""Server-sent events: answers as frames, and frames back as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import words

DONE, ERROR = "[DONE]", "[ERROR]"


def frames(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, frame: one frame per word and a last one that says the answer is done."""
    parts = F.concat(F.transform(words(F.col(text)), lambda w: F.concat(F.lit("data: "), w, F.lit(" \n\n"))), F.array(F.lit(f"data: {DONE}\n\n")))
    return answers.select(F.col(key), F.posexplode(parts).alias("pos", "frame"))


def parsed(streams: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, data of the data lines up to the one that ends the stream; trailing blanks stay.

    A stream with an error line in front of its end fails the job.
    """
    lines = streams.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).where(F.col("line").startswith("data: "))
    lines = lines.withColumn("data", F.expr("substring(line, 7)"))
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("ended", F.max((F.trim("data") == DONE).cast("int")).over(w)).where("ended = 0")
    failed = F.when(F.col("data").startswith(ERROR), F.raise_error(F.col("data")).cast("string")).otherwise(F.col("data"))
    return lines.select(key, "pos", failed.alias("data"))


def joined(parts: DataFrame, key: str) -> DataFrame:
    """key, text: the data of each stream put together."""
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("d"))
    return rows.select(key, F.array_join(F.transform("d", lambda x: x["data"]), "").alias("text"))


def deltas(rows: DataFrame, text: str = "delta") -> DataFrame:
    """The pieces of a model's stream that hold text."""
    return rows.where(F.col(text).isNotNull() & (F.col(text) != ""))
