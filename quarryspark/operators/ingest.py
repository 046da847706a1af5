"""Ingestion: segments, transcripts and pages to rows of the chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import CHUNKS, conform
from ..sources.files import page_text
from ..sources.models import Embedder, embedded, hashing_embedder
from .chunking import chunk_documents, chunk_pages, long_duration_windows


def _finished(rows: DataFrame, kind: str, load: Callable[[], Embedder]) -> DataFrame:
    """Embedded rows of the chunk table; chunks that get no embedding are dropped."""
    rows = rows.withColumns({"chunk_id": F.concat_ws("_", "source_id", F.col("chunk_index").cast("string")), "source_type": F.lit(kind), "embedding": embedded(F.col("text"), load)})
    return conform(rows.where("embedding is not null"), CHUNKS)


def documents(segments: DataFrame, load: Callable[[], Embedder] | None = None, at: Column | None = None) -> DataFrame:
    """Chunks of paged or headed documents: ``segments`` has source_id, seg_idx, text, page_number, section_heading, filename."""
    rows = chunk_documents(segments)
    filename = F.col("filename") if "filename" in segments.columns else F.lit("upload")
    rows = rows.withColumns({"filename": F.coalesce(filename, F.lit("upload")), "page_number": F.coalesce("page_number", F.lit(0)), "section_heading": F.coalesce("section_heading", F.lit("")), "event_at": F.current_timestamp() if at is None else at})
    return _finished(rows, "pdf", load or hashing_embedder())


def transcripts(segments: DataFrame, videos: DataFrame, load: Callable[[], Embedder] | None = None, at: Column | None = None, limit: float = 60.0) -> DataFrame:
    """Chunks of timed transcripts; ``videos`` has source_id, url and html (null: not fetched). Blank chunks stay."""
    title, channel = T.video_metadata(F.coalesce("html", F.lit("")), F.col("url"))
    meta = videos.select("source_id", F.col("url").alias("video_url"), T.video_id(F.col("url")).alias("video_id"), title.alias("title"), channel.alias("channel"))
    rows = long_duration_windows(segments, ["source_id"], limit).join(meta, "source_id")
    return _finished(rows.withColumn("event_at", F.current_timestamp() if at is None else at), "youtube", load or hashing_embedder())


def pages(rows: DataFrame, load: Callable[[], Embedder] | None = None, at: Column | None = None) -> DataFrame:
    """Chunks of web pages (source_id, url, html). Pages without text give none; see ``empty_pages``."""
    rows = rows.withColumns({"title": T.page_title(F.col("html"), F.col("url")), "domain": T.net_location(F.col("url")), "text": page_text(F.col("html"))}).drop("html")
    rows = chunk_pages(rows)
    return _finished(rows.withColumn("event_at", F.current_timestamp() if at is None else at), "web", load or hashing_embedder())


def empty_pages(rows: DataFrame) -> DataFrame:
    """Pages that no text can be read from, with the error of the caller."""
    return rows.where(T.is_blank(page_text(F.col("html")))).select("source_id", "url", F.lit("no text could be extracted").alias("error"))


def only_new(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose identifier is not stored yet, so that ingesting again adds nothing."""
    return chunks.join(stored.select("chunk_id"), "chunk_id", "left_anti")
