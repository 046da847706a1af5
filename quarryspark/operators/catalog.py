"""The catalogue of sources, and their removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import SOURCE_TYPES


def type_order(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SOURCE_TYPES)), c)


def list_sources(chunks: DataFrame) -> DataFrame:
    """One row per source of a collection, from its first chunk; ``video_url`` is not shown. Reads neither texts nor embeddings."""
    first = F.min_by(F.struct("filename", "title", "url", "event_at"), "chunk_index")
    rows = chunks.where(F.col("source_id").isNotNull() & (F.col("source_id") != "")).groupBy("source_type", "source_id").agg(first.alias("m"), F.count("*").alias("chunks"))
    kind = F.col("source_type")
    return rows.select("source_id", "source_type", "m.filename", "m.title", "m.url", F.when(kind == "web", F.lit(None)).otherwise(F.col("m.event_at")).alias("ingested_at"), F.when(kind == "web", F.col("m.event_at")).alias("scraped_at"), "chunks")


def grouped_sources(sources: DataFrame) -> DataFrame:
    """Number of sources per type, in the fixed order of types; empty groups are left out."""
    return sources.groupBy("source_type").agg(F.count("*").alias("sources")).orderBy(type_order(F.col("source_type")))


def labelled_sources(sources: DataFrame) -> DataFrame:
    at = F.coalesce("ingested_at", "scraped_at")
    return sources.withColumns({"label": T.source_label(F.col("filename"), F.col("title"), F.col("url"), F.col("source_id")), "date": F.coalesce(F.date_format(at, "MMM d HH:mm"), F.lit(""))})


def chunk_ids(chunks: DataFrame, source_id: str) -> DataFrame:
    return chunks.where(F.col("source_id") == source_id).select("chunk_id")


def delete_source(chunks: DataFrame, source_id: str) -> tuple[DataFrame, int]:
    """The chunks without those of a source, and the status: 404 if it has none."""
    status = 404 if chunk_ids(chunks, source_id).isEmpty() else 200
    return chunks.where(~F.col("source_id").eqNullSafe(F.lit(source_id))), status


def delete_sources(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks without those of all sources in ``gone`` (source_id)."""
    return chunks.join(gone.select("source_id").distinct(), "source_id", "left_anti")


def toggled(selected: Column, item: Column) -> Column:
    """A selection with an item taken out if it is in, or put in."""
    return F.when(F.array_contains(selected, item), F.array_except(selected, F.array(item))).otherwise(F.array_union(selected, F.array(item)))
