"""Contexts for answers: labelled passages in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_label

SEPARATOR, NOTHING = "\n\n---\n\n", "No context retrieved."


def passage(c: Column) -> Column:
    """Label and text of a retrieved chunk (struct)."""
    label = citation_label(c["source_type"], c["filename"], c["page_number"], c["title"], c["timestamp_start"], c["url"])
    return F.concat(label, F.lit("\n"), F.coalesce(c["text"], F.lit("")))


def context(chunks: Column) -> Column:
    """All passages of an array of retrieved chunks."""
    return F.coalesce(F.nullif(F.array_join(F.transform(chunks, passage), SEPARATOR), F.lit("")), F.lit(NOTHING))


def with_context(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """``queries`` with retrieved_chunks (empty where nothing was found) and context."""
    out = queries.join(lists, "query_id", "left")
    kind = lists.schema["retrieved_chunks"].dataType.simpleString()
    out = out.withColumn("retrieved_chunks", F.coalesce("retrieved_chunks", F.array().cast(kind)))
    return out.withColumn("context", context(F.col("retrieved_chunks")))
