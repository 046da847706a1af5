"""Chunking: recursive splitting of text, greedy duration windows, sections under headings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions import text as T

PDF_SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", " ", "")
WEB_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SIZE, OVERLAP = 1500, 200
#: Texts whose chunks a task holds at once.
STEP = 64


def _pieces(text: str, a: int, b: int, separators: tuple[str, ...], size: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``size`` characters; a separator stays with what follows it."""
    if b - a <= size:
        yield a, b
        return
    for k, s in enumerate(separators):
        if not s:
            yield from ((x, min(b, x + size)) for x in range(a, b, size))
            return
        at = text.find(s, a, b)
        if at < 0:
            continue
        start = a
        while at >= 0:
            if at > start:
                yield from _pieces(text, start, at, separators[k + 1 :], size)
            start, at = at, text.find(s, at + len(s), b)
        yield from _pieces(text, start, b, separators[k + 1 :], size)
        return
    yield from ((x, min(b, x + size)) for x in range(a, b, size))


def split_text(text: str, separators: tuple[str, ...] = PDF_SEPARATORS, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(chunk, its offset): neighbouring pieces up to ``size`` characters, whole trailing pieces of up to ``overlap`` repeated."""
    out: list[tuple[str, int]] = []
    now: list[tuple[int, int]] = []

    def flush() -> None:
        if now:
            raw = text[now[0][0] : now[-1][1]]
            chunk = raw.strip()
            if chunk:
                out.append((chunk, now[0][0] + len(raw) - len(raw.lstrip())))

    for a, b in _pieces(text, 0, len(text), separators, size):
        if now and b - now[0][0] > size:
            flush()
            while now and (now[-1][1] - now[0][0] > overlap or b - now[0][0] > size):
                now.pop(0)
        now.append((a, b))
    flush()
    return out


def split_segments(segments: DataFrame, separators: tuple[str, ...] = PDF_SEPARATORS, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """All columns of ``segments``, with ``text`` split: a row per chunk with chunk_in_segment and char_start, STEP texts at a time."""

    kept = [c for c in segments.columns if c != text]
    rows = segments.select(*kept, text)
    out = StructType([*rows.schema.fields[:-1], StructField("chunk_in_segment", IntegerType()), StructField(text, StringType()), StructField("char_start", IntegerType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, STEP):
                part = b.slice(a, STEP)
                found = [(i, n, c, at) for i, t in enumerate(part.column(len(kept)).to_pylist()) if t for n, (c, at) in enumerate(split_text(t, separators, size, overlap))]
                if found:
                    row, n, chunk, at = zip(*found, strict=True)
                    taken = [c.take(pa.array(row, pa.int32())) for c in part.columns[: len(kept)]]
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(n, pa.int32()), pa.array(chunk, pa.string()), pa.array(at, pa.int32())], out.names)

    return rows.mapInArrow(split, out)


def chunk_documents(segments: DataFrame, separators: tuple[str, ...] = PDF_SEPARATORS, by: str = "source_id") -> DataFrame:
    """Chunks of paged segments; blank ones go first, then ``chunk_index`` runs through all segments of a source.

    Where no source has two segments, a segment's own numbers are that, and no text is shuffled.
    """
    chunks = split_segments(segments.where(~T.is_blank(F.col("text"))), separators).where(~T.is_blank(F.col("text")))
    if segments.groupBy(by).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return chunks.withColumn("chunk_index", F.col("chunk_in_segment"))
    order = W.partitionBy(by).orderBy("seg_idx", "chunk_in_segment")
    return chunks.withColumn("chunk_index", F.row_number().over(order) - 1)


def chunk_pages(pages: DataFrame) -> DataFrame:
    """Chunks of web pages: ``chunk_index`` counts blank chunks too, which are left out."""
    return split_segments(pages, WEB_SEPARATORS).withColumnRenamed("chunk_in_segment", "chunk_index").where(~T.is_blank(F.col("text")))


def duration_windows(segments: DataFrame, by: list[str], limit: float = 60.0, pos: str = "pos") -> DataFrame:
    """Greedy windows over timed segments in the order of ``pos``: by, chunk_index, text, timestamp_start, timestamp_end.

    A window that has a segment ends before the one that would make it last ``limit`` or more. The start of a window
    depends on where the last ended, so a fold over the segments of a source (text, start, duration) decides.
    """
    seg = F.struct(F.col(pos).alias("pos"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("start").cast("double").alias("start"), (F.col("start") + F.coalesce(F.col("duration"), F.lit(0.0))).cast("double").alias("end"))
    lists = segments.groupBy(*by).agg(F.array_sort(F.collect_list(seg)).alias("s"))
    window = "struct<texts: array<string>, start: double, end: double>"
    fold = f"""aggregate(s, named_struct('done', cast(array() as array<{window}>), 'texts', cast(array() as array<string>), 'start', s[0].start, 'end', s[0].start),
        (a, e) -> if(size(a.texts) > 0 and e.end - a.start >= {float(limit)},
            named_struct('done', concat(a.done, array(named_struct('texts', a.texts, 'start', a.start, 'end', a.end))), 'texts', array(e.text), 'start', e.start, 'end', e.end),
            named_struct('done', a.done, 'texts', concat(a.texts, array(e.text)), 'start', a.start, 'end', e.end)),
        a -> if(size(a.texts) > 0, concat(a.done, array(named_struct('texts', a.texts, 'start', a.start, 'end', a.end))), a.done))"""
    rows = lists.select(*by, F.posexplode(F.expr(fold)).alias("chunk_index", "w"))
    return rows.select(*by, "chunk_index", F.array_join("w.texts", " ").alias("text"), T.whole_seconds(F.col("w.start")).alias("timestamp_start"), T.whole_seconds(F.col("w.end")).alias("timestamp_end"))


def long_duration_windows(segments: DataFrame, by: list[str], limit: float = 60.0, pos: str = "pos") -> DataFrame:
    """As ``duration_windows``, for sources of any length: sorted rows stream through, one window is held at a time."""
    names, fields = list(by), ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, texts, start, end = None, 0, [], 0.0, 0.0
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                k = tuple(r[: len(names)])
                stop = r.start + (0.0 if pd.isna(r.duration) else r.duration)
                if texts and (k != key or stop - start >= limit):
                    rows.append((*key, n, " ".join(texts), round(start), round(end)))
                    texts, n = [], n + 1
                if k != key:
                    key, n = k, 0
                if not texts:
                    start = r.start
                texts.append(r.text or "")
                end = stop
            yield pd.DataFrame(rows, columns=[*names, "chunk_index", "text", "timestamp_start", "timestamp_end"])
        if texts:
            yield pd.DataFrame([(*key, n, " ".join(texts), round(start), round(end))], columns=[*names, "chunk_index", "text", "timestamp_start", "timestamp_end"])

    rows = segments.repartition(*by).sortWithinPartitions(*by, pos).select(*by, "start", "duration", "text")
    return rows.mapInPandas(run, f"{fields}, chunk_index int, text string, timestamp_start long, timestamp_end long")


NO_START = -(1 << 62)  # the bucket of events without a start


def stretches(events: DataFrame, by: list[str], limit: float) -> DataFrame:
    """``events`` with _stretch: numbers, per ``by``, of stretches that gaps of at least ``limit`` part.

    Gaps are found between buckets of ``limit`` seconds: a partial aggregate, of as many rows as the time span has buckets,
    however many events there are. Where an event has no start, no gap is certain, and all of its ``by`` is one stretch.
    """
    rows = events.withColumn("_b", F.coalesce(F.floor(F.col("start") / limit).cast("long"), F.lit(NO_START)))
    whole = W.partitionBy(*by)
    w = whole.orderBy("_b")
    thin = rows.groupBy(*by, "_b").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    thin = thin.withColumns({"new": F.coalesce((F.col("lo") - F.lag("hi").over(w) >= limit).cast("long"), F.lit(0)), "least": F.min("_b").over(whole)})
    thin = thin.withColumn("_stretch", F.when(F.col("least") == NO_START, 0).otherwise(F.sum("new").over(w)).cast("long"))
    return _null_safe(rows, thin.select(*by, "_b", "_stretch"), [*by, "_b"]).drop("_b")


def _null_safe(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """A join in which null keys meet; the keys stay once."""
    other = other.withColumnsRenamed({c: f"_o_{c}" for c in keys})
    on = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in keys]
    return rows.join(other, on).drop(*[f"_o_{c}" for c in keys])


def timed_windows(events: DataFrame, by: list[str], limit: float, order: list[str]) -> DataFrame:
    """As ``duration_windows``, for events in an ``order`` that has no start before an earlier one, and no negative durations.

    A gap of at least ``limit`` between starts ends a window for certain, so the stretches between gaps are dealt to tasks by
    themselves; sorted rows stream through, and one window is held at a time.
    """
    names = [*by, "_stretch"]
    fields = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, texts, start, end, types = None, 0, [], None, None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [*types, pa.int64(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*names, "n", "text", "start", "end"])

        for b in batches:
            types = [b.schema.field(c).type for c in names]
            done = []
            for *k, s, d, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                stop = None if s is None else s + (d or 0.0)
                if texts and (k != key or (stop is not None and start is not None and stop - start >= limit)):
                    done.append((*key, n, " ".join(texts), start, end))
                    texts, n = [], n + 1
                if k != key:
                    key, n = k, 0
                if not texts:
                    start = s
                texts.append(t or "")
                end = stop
            yield out(done)
        if texts:
            yield out([(*key, n, " ".join(texts), start, end)])

    rows = stretches(events, by, limit).repartition(*names).sortWithinPartitions(*names, *order)
    rows = rows.select(*names, F.col("start").cast("double"), F.col("duration").cast("double"), "text")
    found = rows.mapInArrow(run, f"{fields}, _stretch long, n long, text string, start double, end double")
    before = W.partitionBy(*by).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    counts = found.groupBy(*names).agg(F.count("*").alias("_n"))
    counts = counts.select(*names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    index = (F.col("_before") + F.col("n")).cast("int").alias("chunk_index")
    return _null_safe(found, counts, names).select(*by, index, "text", T.whole_seconds(F.col("start")).alias("timestamp_start"), T.whole_seconds(F.col("end")).alias("timestamp_end"))


def sections(paragraphs: DataFrame, by: str = "source_id") -> DataFrame:
    """by, seg_idx, section_heading, text: paragraphs under the heading in front of them.

    A heading without text leaves the last one in force; blank paragraphs and headings without paragraphs give
    nothing; what stands before the first heading has none.
    """
    run = W.partitionBy(by).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    body = T.strip(F.coalesce(F.col("text"), F.lit("")))
    rows = paragraphs.withColumn("_t", body).withColumns({
        "seg_idx": F.sum(F.col("is_heading").cast("int")).over(run),
        "section_heading": F.last(F.when(F.col("is_heading") & (F.col("_t") != ""), F.col("_t")), ignorenulls=True).over(run),
    })
    rows = rows.where(~F.col("is_heading") & (F.col("_t") != ""))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]), "\n")
    return rows.groupBy(by, "seg_idx", "section_heading").agg(lines.alias("text")).withColumn("page_number", F.lit(None).cast("int"))


def consecutive_runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``run``: the number of the run of equal neighbouring values each stands in, from 0."""
    w = W.partitionBy(by).orderBy(order)
    change = (~F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull()).cast("int")
    return rows.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")).drop("_change")


def ordered_concat(order: str, text: str, separator: str) -> Column:
    """An aggregate: texts in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)
