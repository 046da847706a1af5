"""Operator 8, removal of repeated strings: a distributed difference-cover suffix sort.

Every byte covered by a ``LENGTH``-byte string that also starts earlier goes. Which strings do is settled in
steps that lose none, so that only the places where that is hard reach the suffix sort:

1. Of documents with the same bytes only the first needs a look; later ones go wholly.
2. A narrow pass cuts the start positions of each text into runs: neighbouring windows of LENGTH bytes whose least
   hash of ``GRAM`` bytes is the same. Equal windows have equal least hashes, so a window can only recur in runs
   with its hash; hashes that one run has are out (most of the text).
3. Runs that are equal as a whole to an earlier run are removed: the inside of a long repeat costs one row per
   run, however often it occurs.
4. Different runs with one hash, the edges of repeats, go to the suffix sort, with their bytes (the texts that
   have such runs are joined with the places of these, so only the bytes of edges go on). Suffixes are sampled at one
   place in BLOCK, counted from the place of the least hash: since equal windows have it at equal places, that cover
   meets any two equal suffixes at the same distance, where a cover blind to the text takes two places in three.
   The triples of SYMBOL bytes at the sampled places are sorted and named by rank. A triple spells all of the
   LENGTH bytes but BLOCK - 1, so there is nothing to recurse for; the remaining suffixes merge with the sampled
   ones by the name, the distance to it and the few bytes around. Of suffixes with equal prefixes, neighbours in
   that order, all but the first are covered.
5. Covered stretches are united per document and cut out of its bytes.

A passage that many documents share meets in map-side partial minima, and its rows take what was found about it by a
broadcast of the few heavy keys, never in one task. Texts are hashed in parts of PART bytes, so memory doesn't grow
with the longest text. Whole documents, whole runs and whole blocks are compared by hashes of 256, 127 and 128 bits;
windows in the suffix order by their bytes.

Defined cases: null text has no bytes; texts under LENGTH bytes lose nothing; the first of equal texts (smallest
doc_id) stays; rows equal in doc_id and text are one document: all stay or are cut alike, a row each; different texts under
one doc_id, or without one, are documents of their own, in the order of their digests; a null doc_id comes first; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import drop_stored, left_join_groups, may_hit, stored, table, without
from .sharding import numbered

LENGTH, GRAM, BLOCK, SYMBOL = 100, 48, 8, 31
CORE = LENGTH - BLOCK + 1  # bytes that all windows of a block share: a triple of symbols
WINDOW = LENGTH - GRAM + 1  # grams in a window
MOST = 64  # windows in a run at most
PART = 256_000  # bytes hashed at once

_A, _B, _C, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_R), -1, 1 << 64))
    up, down = np.full(n, _R), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _grams(raw: bytes, n: int) -> np.ndarray:
    """Hashes of the GRAM bytes from each of the first ``n`` places on; ``raw`` has GRAM bytes more."""
    word = np.ndarray((n + GRAM - 8,), "<u8", raw, strides=(1,))
    h = word[:n] * _A
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(31)
        h += word[k : k + n]
        h *= _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For all runs: text, first window, windows, least hash, digest of the run's bytes, may it repeat within."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(size.sum())
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    raw = b"".join(texts) + bytes(GRAM)
    h = _grams(raw, n)
    least, span = h, 1
    while span * 2 <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[WINDOW - span : n - span + 1])  # of windows starting at each byte
    begin = np.cumsum(size) - size
    many = np.maximum(size - LENGTH + 1, 0)
    whose = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)  # window start in its text
    v = least[begin[whose] + at]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (at[1:] == 0)
    first = np.flatnonzero(new)
    count = np.diff(first, append=len(v))
    parts = -(-count // MOST)  # long runs (periodic text) are split
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = np.repeat(first, parts) + nth * MOST, np.minimum(MOST, np.repeat(count, parts) - nth * MOST)
    up, down = _powers(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:n])))
    start = begin[whose[first]] + at[first]
    digest = (total[start + count + WINDOW - 1] - total[start]) * down[start] + count.astype(np.uint64) * _A
    # a run repeats within only if its least hash stands at two neighbouring least places (periodic text)
    peak, span = np.concatenate((np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64))), 1
    while span * 2 <= WINDOW:
        peak = np.maximum(peak[:-span], peak[span:])
        span *= 2
    peak = np.maximum(peak[:n], peak[WINDOW - span : n + WINDOW - span])
    places = np.flatnonzero(peak == h)
    twin = np.flatnonzero((h[places[1:]] == h[places[:-1]]) & (np.diff(places) <= WINDOW))
    within = np.zeros(len(start) + 1, np.int64)
    if len(twin):
        low = np.maximum(np.searchsorted(start, places[twin + 1] - WINDOW + 1, side="right") - 1, 0)
        high = np.searchsorted(start, places[twin], side="right")
        np.add.at(within, low, 1)
        np.add.at(within, np.maximum(high, low), -1)
    return whose[first], at[first], count, (v[first] >> np.uint64(1)).view(np.int64), digest.view(np.int64), np.cumsum(within)[:-1] > 0


def _parts(values: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Whose, from where and what: windows of all texts, some PART bytes at a time."""
    whose, at, what, total = [], [], [], 0
    for i, raw in enumerate(values):
        for a in range(0, max(len(raw) - LENGTH + 1, 0), PART):
            part = raw[a : a + PART + LENGTH - 1] if len(raw) > PART else raw
            if total and total + len(part) > PART:
                yield whose, at, what
                whose, at, what, total = [], [], [], 0
            whose.append(i)
            at.append(a)
            what.append(part)
            total += len(part)
    if what:
        yield whose, at, what


def all_runs(firsts: DataFrame) -> DataFrame:
    """doc_id, start, windows, v, digest, within of every run of ``firsts`` (doc_id, raw)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["doc_id"].to_numpy()
            for of, begin, what in _parts(b["raw"].tolist()):
                whose, at, count, v, digest, within = runs(what)
                at = at + np.array(begin, np.int64)[whose]
                yield pd.DataFrame({"doc_id": ids[np.array(of)[whose]], "start": at.astype(np.int32), "windows": count.astype(np.int16), "v": v, "digest": digest, "within": within.astype(bool)})

    return firsts.mapInPandas(run, "doc_id long, start int, windows short, v long, digest long, within boolean")


def blocks(raws: list[bytes], v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Run, first window, windows and core of the blocks that runs (their bytes, their least hashes) fall into.

    A window's anchor is the first place of its least hash, a property of its bytes; windows whose anchors lie
    BLOCK * b up to BLOCK * b + BLOCK - 1 bytes behind their start make a block. All windows of a block contain
    the CORE bytes from ``core`` on, and equal windows have equal places in their blocks.
    """
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    n = int(size.sum())
    h = (_grams(b"".join(raws) + bytes(GRAM), n) >> np.uint64(1)).view(np.int64)
    begin = np.cumsum(size) - size
    place = np.where(h == np.repeat(v, size), np.arange(n), n)
    place = np.minimum.accumulate(place[::-1])[::-1]  # the next anchor from each byte on
    many = size - LENGTH + 1
    run = np.repeat(np.arange(len(raws)), many)
    at = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    anchor = place[begin[run] + at] - begin[run]
    core = anchor - (anchor - at) // BLOCK * BLOCK
    new = np.ones(len(run), bool)
    new[1:] = (core[1:] != core[:-1]) | (run[1:] != run[:-1])
    first = np.flatnonzero(new)
    return run[first], at[first], np.diff(first, append=len(run)), core[first]


def edge_blocks(firsts: DataFrame, hard: DataFrame) -> DataFrame:
    """doc_id, start, windows, at (of the core in raw), raw: the blocks of ``hard`` (doc_id, start, windows, v), runs of ``firsts``."""
    lists = stored(hard.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "v")).alias("runs")), "suffix-hard")
    near = may_hit(firsts, lists, F.xxhash64("doc_id"), lists.count())
    each = near.join(lists, "doc_id").select("doc_id", "raw", F.explode("runs").alias("r"))
    each = each.select("doc_id", F.col("r.start").alias("start"), F.col("r.v").alias("v"), F.expr(f"substring(raw, r.start + 1, r.windows + {LENGTH - 1})").alias("raw"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), PART // (2 * LENGTH)):
                part = b.iloc[a : a + PART // (2 * LENGTH)]
                raws, start = part["raw"].tolist(), part["start"].to_numpy()
                r, first, m, core = blocks(raws, part["v"].to_numpy())
                raw = [raws[i][f:t] for i, f, t in zip(r.tolist(), first.tolist(), (first + m + LENGTH - 1).tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[r], "start": (start[r] + first).astype(np.int32), "windows": m.astype(np.int32), "at": (core - first).astype(np.int32), "raw": raw})

    return each.mapInPandas(run, "doc_id long, start int, windows int, at int, raw binary")


def covered_windows(edges: DataFrame, order: Column) -> DataFrame:
    """doc_id, a, b: windows of ``edges`` (as of ``edge_blocks``) that equal an earlier one, by the suffix sort."""
    rows = edges.withColumns({"core": F.expr(f"substring(raw, at + 1, {CORE})"), "order": order})
    rows = stored(rows.withColumns({"c": F.xxhash64("core"), "x": F.xxhash64("raw", "at"), "y": F.xxhash64(F.lit(1), "at", "raw")}), "suffix-edges")
    alike = (F.min("x") == F.max("x")) & (F.min("y") == F.max("y"))
    kinds = stored(rows.groupBy("c").agg(F.count("*").alias("m"), alike.alias("alike"), F.min("order").alias("first")).where("m > 1"), "suffix-cores")
    near = may_hit(rows, kinds, F.col("c"), kinds.count())
    near = left_join_groups(near.select("doc_id", "start", "windows", "at", "raw", "core", "order", "c"), kinds, "c", "m", rows.count()).where("m > 1")
    near = stored(near, "suffix-blocks")
    same = near.where("alike and order > first").select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("windows") + (LENGTH - 1)).cast("int").alias("b"))

    # the cover: the triples of symbols at the sampled positions, sorted and named by their rank
    several = near.where("not alike").select("doc_id", "start", "windows", "at", "raw", "core", "order")
    triple = [F.expr(f"substring(core, {1 + k * SYMBOL}, {SYMBOL})").alias(f"s{k}") for k in range(3)]
    names, _ = numbered(several.groupBy("core").agg(F.count("*").alias("uses")).select("core", "uses", *triple), ["s0", "s1", "s2"])
    several = left_join_groups(several, names.select("core", "uses", F.col("row_number").alias("name")), "core", "uses", near.count())
    # the other suffixes merge with them: by the name of the core, the distance to it, and the bytes around it
    each = several.select("doc_id", "name", F.explode(F.expr("sequence(0, windows - 1)")).alias("i"), "start", "at", "raw", "order")
    around = F.concat(F.expr("substring(raw, i + 1, at - i)"), F.expr(f"substring(raw, at + {CORE} + 1, i + {LENGTH} - at - {CORE})"))
    each = each.select("doc_id", (F.col("start") + F.col("i")).cast("int").alias("a"), (F.col("order") + F.col("i")).alias("order"), "name", (F.col("at") - F.col("i")).cast("byte").alias("distance"), around.alias("around"))
    each = stored(each.withColumn("key", F.encode(F.concat_ws(":", "name", "distance", F.hex("around")), "UTF-8")).drop("name", "distance", "around"), "suffix-order")
    groups = stored(each.groupBy("key").agg(F.min("order").alias("first"), F.count("*").alias("uses")).where("uses > 1"), "suffix-groups")
    marked = left_join_groups(may_hit(each, groups, F.xxhash64("key"), groups.count()), groups, "key", "uses", each.count())
    return same.unionByName(marked.where("order > first").select("doc_id", "a", (F.col("a") + LENGTH).cast("int").alias("b")))


def _order(thin: DataFrame) -> Column:
    """A number for (doc_id, start): a long where both fit in, else a decimal."""
    r = thin.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("n_bytes").alias("n")).first()
    if r["a"] is None or (r["b"] - r["a"] < 1 << 33 and r["n"] < 1 << 29):
        return (F.col("doc_id") - F.lit(r["a"] or 0)) * (1 << 29) + F.col("start")
    return F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("start")


def _united(stretches: DataFrame) -> DataFrame:
    """doc_id, cut: maximal stretches [a, b) of ``stretches`` (doc_id, a, b), in order."""
    w = W.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = stretches.withColumn("new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int"))
    whole = new.withColumn("nth", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc_id", "nth").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cut"))


def _documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (doc_id, raw, digest) in which a doc_id, never null, names one text; them without raw but with n_bytes, stored; and where
    that takes new numbers, doc_id (null first), digest, row_number of all documents in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("raw"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("raw", 256)))
    size = F.length("raw").cast("long").alias("n_bytes")
    thin = stored(rows.select("doc_id", "digest", size), "suffix-documents")
    x, y = F.xxhash64("digest"), F.xxhash64(F.lit(1), "digest")
    several = (F.min(x) != F.max(x)) | (F.min(y) != F.max(y)) | F.col("doc_id").isNull()
    if thin.groupBy("doc_id").agg(several.alias("several")).where("several").isEmpty():
        return rows, thin, None
    drop_stored(thin)
    names = stored(numbered(thin_rows := rows.select("doc_id", "digest").distinct(), ["doc_id", "digest"])[0].select(*thin_rows.columns, "row_number"), "suffix-names")
    named = names.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "row_number")
    rows = rows.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))).select(F.col("row_number").alias("doc_id"), "raw", "digest")
    rows = stored(rows, "suffix-texts")
    return rows, stored(rows.select("doc_id", "digest", size), "suffix-documents"), names


def repeated_strings(rows: DataFrame, thin: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest, later (goes wholly), cut (array of [a, b) byte stretches to remove): one row per row of ``rows``
    (as ``thin``: of ``_documents``)."""
    total = thin.count()
    same = stored(thin.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("uses")).where("uses > 1"), "suffix-same")
    thin = left_join_groups(thin, same, "digest", "uses", total).select("doc_id", "n_bytes", "digest", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("later"))
    thin = stored(thin, "suffix-rows")
    later = thin.where("later").select("doc_id")
    n_later = later.count()
    firsts = without(rows.select("doc_id", "raw"), later, n_later)

    every = stored(all_runs(firsts), "suffix-runs")
    shared = every.groupBy("v").agg(F.count("*").alias("m"), F.max("within").alias("within")).where("m > 1 or within").select("v")
    shared = stored(shared, "suffix-shared")
    order = _order(thin)
    # a few runs that only seem to share their hash may come along: they are alone of their kind
    near = stored(may_hit(every, shared, F.col("v"), shared.count()).withColumn("order", order), "suffix-near")
    for frame in (every, shared):
        drop_stored(frame)
    kinds = near.groupBy("v", "digest").agg(F.min(F.struct("order", "doc_id", "start", "windows")).alias("first"), F.count("*").alias("uses"), F.max("within").alias("within"))
    kinds = stored(kinds, "suffix-kinds")
    key = F.concat(F.unhex(F.lpad(F.hex("v"), 16, "0")), F.unhex(F.lpad(F.hex("digest"), 16, "0"))).alias("key")
    groups = kinds.where("uses > 1").select(key, F.col("first.order").alias("first"), "uses")
    whole = left_join_groups(near.select("doc_id", "start", "windows", "order", key), groups, "key", "uses", near.count()).where("order > first")
    whole = whole.select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("windows") + (LENGTH - 1)).cast("int").alias("b"))

    several = kinds.groupBy("v").agg(F.count("*").alias("m"), F.max("within").alias("any")).where("m > 1 or any")
    hard = left_join_groups(kinds.select("v", "first"), several, "v", "m", kinds.count()).where("m is not null").select("first.doc_id", "first.start", "first.windows", "v")
    covered = covered_windows(edge_blocks(firsts, hard), order)
    cut = stored(_united(whole.unionByName(covered)), "suffix-cut")
    return thin.join(cut, "doc_id", "left").select("doc_id", "n_bytes", "digest", "later", "cut")


def cut_out(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``."""
    rows, thin, names = _documents(docs)
    marks = stored(repeated_strings(rows, thin), "suffix-marks")
    empty = hashlib.sha256(b"").hexdigest()
    plain = marks.where("later or cut is null")
    gone = F.col("later") & (F.col("n_bytes") >= LENGTH)
    plain = plain.select("doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"), F.when(gone, F.lit(empty)).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"))
    some = marks.where("not later and cut is not null").select("doc_id", "cut").dropDuplicates(["doc_id"])  # rows of one document
    near = may_hit(rows.select("doc_id", "raw"), some, F.xxhash64("doc_id"), some.count()).join(some, "doc_id")
    # what stays lies between the stretches; joined as hexadecimal digits, once
    between = "transform(sequence(0, size(cut)), j -> hex(substring(raw, if(j = 0, 0, cut[j - 1].b) + 1, if(j = size(cut), length(raw), cut[j].a) - if(j = 0, 0, cut[j - 1].b))))"
    kept = F.unhex(F.expr(f"array_join({between}, '')"))
    cut = near.select("doc_id", F.length("raw").cast("long").alias("n_bytes"), F.expr("aggregate(cut, 0L, (n, s) -> n + s.b - s.a)").alias("n_removed"), F.size("cut").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))
    out = plain.unionByName(cut)
    if names is None:
        return out
    ids = names.select(F.col("doc_id").alias("id"), "row_number")
    return out.join(ids, F.col("doc_id") == F.col("row_number")).select(F.col("id").alias("doc_id"), *out.columns[1:])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_out(table(spark, sf_dir, "documents"))
