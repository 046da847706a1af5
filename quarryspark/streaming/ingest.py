"""Continuous ingestion and event windows on Structured Streaming. Extensions: the batch operators define the semantics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import ingest
from ..sources.files import append_chunks
from ..sources.models import Embedder


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-line files as they land in a folder."""
    return spark.readStream.schema(schema).json(path)


def ingest_pages(pages: DataFrame, table: str, checkpoint: str, load: Callable[[], Embedder] | None = None) -> DataStreamWriter:
    """Append the chunks of landed pages (url, html, fetched_at) to a chunk table.

    The source identifier depends on the content, and a page that landed within the last day is not taken again.
    """
    rows = pages.withColumn("source_id", T.content_id(F.col("url"), F.col("html"))).withWatermark("fetched_at", "1 day").dropDuplicatesWithinWatermark(["source_id"])

    def write(batch: DataFrame, _: int) -> None:
        append_chunks(ingest.pages(batch.select("source_id", "url", "html", "fetched_at"), load, F.col("fetched_at")), table)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) per tumbling window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def streaming_duration_windows(segments: DataFrame, limit: float = 60.0) -> DataFrame:
    """Greedy duration windows over a stream of timed segments (source_id, pos, text, start, duration).

    The open window of a source is its state; a segment that would make it last ``limit`` closes it. Segments of
    one source must arrive in order over batches. A segment with null text ends its source.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, texts, start, end = state.get if state.exists else (0, [], 0.0, 0.0)
        texts, out = list(texts), []
        for r in pd.concat(list(batches)).sort_values("pos").itertuples():
            ends = not isinstance(r.text, str)
            stop = r.start + (0.0 if pd.isna(r.duration) else r.duration)
            if texts and (ends or stop - start >= limit):
                out.append((key[0], n, " ".join(texts), round(start), round(end)))
                n, texts = n + 1, []
            if ends:
                break
            if not texts:
                start = float(r.start)
            texts.append(r.text)
            end = float(stop)
        if texts or n:
            state.update((n, texts, start, end))
        yield pd.DataFrame(out, columns=["source_id", "chunk_index", "text", "timestamp_start", "timestamp_end"])

    return segments.groupBy("source_id").applyInPandasWithState(step, "source_id string, chunk_index int, text string, timestamp_start long, timestamp_end long", "n int, texts array<string>, start double, end double", "append", GroupStateTimeout.NoTimeout)
