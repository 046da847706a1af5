"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import mark_hit, may_hit
from ..sources.scratch import drop_stored, shared_dir, stored

__all__ = ["drop_stored", "left_join_groups", "lower_ascii", "mark_hit", "may_hit", "shared_dir", "stored", "table", "without"]

#: The letters that "lower-case A-Z" touches.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the contracts, as a Java regex class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the fast way for text without other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def without(rows: DataFrame, gone: DataFrame, n_gone: int, mark: Column | None = None) -> DataFrame:
    """``rows`` that are not in ``gone`` by doc_id (a long, nulls too) and, where given, by ``mark`` (its column of ``gone``
    has that name). Only rows whose doc_id the bitmap names are shuffled for the exact test. Columns may have any names."""
    if not n_gone:
        return rows
    none = F.lit(0)
    keyed = rows.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), (none if mark is None else mark).alias("mark"))
    named = gone.select(F.col("doc_id").alias("gone"), (none if mark is None else F.col("mark")).alias("gone_mark")).distinct()
    marked = mark_hit(keyed, gone, F.xxhash64("id"), n_gone, F.xxhash64(F.col("doc_id").cast("long")))
    tested = marked.where("_hit").join(named, F.col("id").eqNullSafe(F.col("gone")) & (F.col("mark") == F.col("gone_mark")), "left_anti")
    return marked.where("not _hit").unionByName(tested).select("row.*")


def left_join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-join ``rows`` with one row per group, where some groups may hold a large share of ``rows``.

    Groups over a thousandth of ``total`` number a thousand at most; these are broadcast. Rows they
    match leave the shuffle join through keys of their own, so no task gets more than a thousandth
    of the rows by one key. ``key`` is a binary or long column.
    """
    values = [c for c in groups.columns if c != key]
    heavy = groups.where(F.col(size) * 1000 > F.lit(total)).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values])
    light = groups.where(F.col(size) * 1000 <= F.lit(total)).select(F.col(key).alias("_lk"), *[F.col(c).alias(f"_l_{c}") for c in values])
    dealt = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    spread = F.xxhash64(F.uuid()) if rows.schema[key].dataType.typeName() == "long" else F.encode(F.uuid(), "UTF-8")
    dealt = dealt.withColumns({"_jk": F.when(F.col("_hk").isNull(), F.col(key)).otherwise(spread), "_jh": F.col("_hk").isNotNull()})
    light = light.withColumn("_lh", F.lit(False))
    out = dealt.join(light, (F.col("_jk") == F.col("_lk")) & (F.col("_jh") == F.col("_lh")), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in values])
