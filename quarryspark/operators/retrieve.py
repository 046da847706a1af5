"""Retrieval: exact cosine top-k of a set of queries per source, union, and dedup of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schemas import SOURCE_TYPES
from ..sources.scratch import stored
from .filters import may_hit

K = 5
#: Queries that are sent to all tasks at once (at 384 dimensions 25 MB in single precision).
BLOCK = 16384
#: Queries and vectors of one matrix product, and pairs whose exact distances are held at once.
SLICE, ROWS, PAIRS = 512, 4096, 20_000


def _flat(column: pa.Array) -> np.ndarray:
    """Vectors (lists of one length, none of them null) as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _least(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` least distances of each row of ``d`` and their ids, ties by id (null first), in that order.

    ``ids`` is one array for all rows, or one a row.
    """
    if ids.ndim == 1:
        order = np.argsort(pd.factorize(ids, sort=True)[0], kind="stable")
        d, ids = d[:, order], ids[order]
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(d, at, 1), ids[at]
    rank = pd.factorize(ids.reshape(-1), sort=True)[0].reshape(ids.shape)
    at = np.lexsort((rank, d), axis=1)[:, :k]
    return np.take_along_axis(d, at, 1), np.take_along_axis(ids, at, 1)


def _first(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least distances of each query, ties by id (null first), in that order."""
    at = np.lexsort((pd.factorize(ids, sort=True)[0], d, q))
    return at[np.arange(len(at)) - np.searchsorted(q[at], q[at]) < k]


def _same(v: np.ndarray) -> np.ndarray:
    """For each row of ``v`` a number that only equal rows share: a sum of its bits, whose equals are compared."""
    odd = np.random.default_rng(1).integers(0, 1 << 63, v.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    v = np.ascontiguousarray(v)
    bits = np.einsum("ij,j->i", v.view(np.uint64), odd)
    _, first, same = np.unique(bits, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[same] != np.arange(len(v)))
    if len(again) and not np.array_equal(v[again].view(np.uint64), v[first[same[again]]].view(np.uint64)):
        same = np.unique(v.view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True)[1]
    return same.ravel()


class _Best:
    """The ``k`` nearest rows seen so far for each query (unit vectors, or zero).

    Products in single precision tell which rows may be among them; distances of those alone are computed exactly, pair by pair, so that equal
    vectors have equal ones wherever they stand.
    """

    def __init__(self, units: np.ndarray, k: int, single: np.ndarray | None = None):
        self.units, self.single, self.k = units, units.astype(np.float32) if single is None else single, k
        self.blank = ~units.any(axis=1)  # as far from all rows
        self.low = np.where(self.blank, np.inf, -np.inf).astype(np.float32)  # what a row's product must reach
        self.slack = np.float32((units.shape[1] + 4) * 2.0**-23)  # twice the rounding of a product
        self.q, self.d, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)

    def add(self, v: np.ndarray, ids: np.ndarray) -> None:
        norm = np.linalg.norm(v, axis=1)
        there = np.isfinite(norm) & (norm > 0)
        v, ids, norm = v[there], ids[there], norm[there]
        if not len(v):
            return
        # of equal vectors only the k least ids can be among the nearest
        same = _same(v)
        if same.max() + 1 < len(v):
            at = np.sort(_first(same, np.zeros(len(v)), ids, self.k))
            v, ids, norm = v[at], ids[at], norm[at]
        for a in range(0, len(v), ROWS):
            self._add(v[a : a + ROWS], ids[a : a + ROWS], norm[a : a + ROWS])

    def _add(self, v: np.ndarray, ids: np.ndarray, norm: np.ndarray) -> None:
        single, q, d, names = (v / norm[:, None]).astype(np.float32).T, [self.q], [self.d], [self.ids]
        blank = np.flatnonzero(self.blank)
        if len(blank):
            least = _least(np.ones((1, len(v))), ids, self.k)[1][0]
            q.append(np.repeat(blank, len(least)))
            d.append(np.ones(len(blank) * len(least)))
            names.append(np.tile(least, len(blank)))
        for a in range(0, len(self.units), SLICE):
            product = self.single[a : a + SLICE] @ single
            hit = product >= self.low[a : a + SLICE, None]
            row, at = np.divmod(np.flatnonzero(hit), len(v))  # in one dimension, as few are hit
            many = np.flatnonzero(np.bincount(row, minlength=len(product)) > 8 * self.k)
            if len(many):
                hit[many] &= product[many] >= np.partition(product[many], -self.k, axis=1)[:, -self.k, None] - self.slack
                row, at = np.divmod(np.flatnonzero(hit), len(v))
            for b in range(0, len(row), PAIRS):
                r, c = row[b : b + PAIRS] + a, at[b : b + PAIRS]
                q.append(r)
                d.append(1 - (self.units[r] * v[c]).sum(axis=1) / norm[c])
                names.append(ids[c])
        q, d, ids = np.concatenate(q), np.concatenate(d), np.concatenate(names)
        keep = _first(q, d, ids, self.k)
        self.q, self.d, self.ids = q[keep], d[keep], ids[keep]
        last = np.flatnonzero((np.arange(len(keep)) - np.searchsorted(self.q, self.q) == self.k - 1) & ~self.blank[self.q])
        self.low[self.q[last]] = (1 - self.d[last]).astype(np.float32) - self.slack


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "chunk_id", group_col: str = "source_type", query_col: str = "query_id") -> DataFrame:
    """query, group, id, distance, rank: the ``k`` nearest rows of each group for each query, ties by id.

    ``vectors`` has id, group and embedding. Some BLOCK queries are sent to the tasks: each keeps exactly ``k`` rows of its
    batches per query and group, ties by id, from a matrix product; only those candidates are shuffled. More queries go in slices of that
    size, and what one has found is stored before the next: the vectors are read once a slice, by as many tasks as there are
    cores, and never shuffled, so disk grows with the queries alone. Queries without a vector are left out.
    """
    spark = vectors.sparkSession
    asked = queries.where("embedding is not null").select(query_col, "embedding")
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = f"{query_col} {queries.schema[query_col].dataType.simpleString()}, {group_col} {types[group_col]}, {id_col} {types[id_col]}, distance double"
    number = asked.count()
    slices = -(-number // BLOCK)
    if not slices:
        return spark.createDataFrame([], schema + ", rank int")
    rows = vectors.where("embedding is not null").select(id_col, group_col, "embedding")
    if 8 * number > BLOCK:  # each task begins anew with all queries
        rows = rows.coalesce(spark.sparkContext.defaultParallelism)
    if slices == 1:
        return _nearest_slice(rows, asked, k, schema)[0]
    part = F.pmod(F.xxhash64(query_col, "embedding"), F.lit(slices))
    out = None
    for s in range(slices):
        found, sent = _nearest_slice(rows, asked.where(part == s), k, schema)
        found = stored(found, "nearest")
        if sent is not None:
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _nearest_slice(rows: DataFrame, asked: DataFrame, k: int, schema: str) -> tuple[DataFrame, Broadcast | None]:
    """``nearest`` for queries (query, embedding) of a bounded number, and what was sent for it. ``rows`` has id, group, embedding."""
    spark = rows.sparkSession
    (query_col, id_col), group_col = (asked.columns[0], rows.columns[0]), rows.columns[1]
    few = asked.toArrow().combine_chunks()  # its size is checked by the caller
    if not few.num_rows:
        return spark.createDataFrame([], schema + ", rank int"), None
    keys, matrix = few.column(0).combine_chunks(), few.column(1).combine_chunks()
    sent = spark.sparkContext.broadcast((keys, matrix))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix = sent.value
        units = _units(_flat(matrix))
        kept: dict = {}
        kinds, single = None, units.astype(np.float32)
        for b in batches:
            kinds = b.schema.types
            groups = np.array([*b.column(1).to_pylist(), None], object)[:-1]
            ids = np.array([*b.column(0).to_pylist(), None], object)[:-1]
            code, names = pd.factorize(groups)
            for c in np.unique(code):
                at = np.flatnonzero(code == c)
                name = None if c < 0 else names[c]
                kept.setdefault(name, _Best(units, k, single)).add(_flat(b.column(2) if len(at) == len(ids) else b.column(2).take(pa.array(at))), ids[at])
        for name, found in kept.items():
            columns = [keys.take(pa.array(found.q)), pa.array([name] * len(found.q), kinds[1]), pa.array(found.ids.tolist(), kinds[0]), pa.array(found.d)]
            yield pa.RecordBatch.from_arrays(columns, [query_col, group_col, id_col, "distance"])

    w = W.partitionBy(query_col, group_col).orderBy("distance", id_col)
    return rows.mapInArrow(best, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), sent


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = K, enforce_user_sources: bool = False) -> DataFrame:
    """query_id, source_pos, source_type, rank, chunk_id, text, distance and all metadata: what the queries retrieve.

    ``queries`` has query_id, embedding, sources_to_use (array) and source_ids (array; null or empty: no filter),
    and with ``enforce_user_sources`` also sources: those that the user allows. The best ``k`` of each source come
    first, then of equal texts the first in (source position, rank) stays. Unknown sources find nothing.
    """
    q = queries
    if enforce_user_sources:
        allowed = F.coalesce(F.col("sources"), F.array().cast("array<string>"))
        q = q.withColumn("sources_to_use", F.when(F.size(allowed) > 0, F.array_intersect("sources_to_use", allowed)).otherwise(F.col("sources_to_use")))
    wanted = q.select("query_id", "embedding", "source_ids", F.posexplode("sources_to_use").alias("source_pos", "source_type")).where(F.col("source_type").isin(*SOURCE_TYPES))
    wanted = wanted.groupBy("query_id", "source_type").agg(F.min("source_pos").alias("source_pos"), F.first("source_ids").alias("source_ids"))
    open_ = wanted.where("source_ids is null or size(source_ids) = 0").select("query_id", "source_type", "source_pos")
    vectors = chunks.where(F.col("embedding").isNotNull() & F.col("source_type").isin(*SOURCE_TYPES))
    found = nearest(vectors, q.join(open_.select("query_id").distinct(), "query_id", "left_semi"), k).join(open_, ["query_id", "source_type"])
    # queries with a list of sources are few rows against their own sources: an equi join, no scan of all pairs
    listed = wanted.where("size(source_ids) > 0").select("query_id", "source_type", "source_pos", F.explode(F.array_distinct("source_ids")).alias("source_id"))
    from ..functions.vectors import cosine_distance

    pairs = listed.join(vectors.select("chunk_id", "source_id", "source_type", F.col("embedding").alias("_v")), ["source_type", "source_id"])
    pairs = pairs.join(q.select("query_id", F.col("embedding").alias("_q")), "query_id").withColumn("distance", cosine_distance(F.col("_v"), F.col("_q"))).where("distance is not null")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "source_type").orderBy("distance", "chunk_id"))).where(F.col("rank") <= k)
    found = stored(found.unionByName(ranked.select(*found.columns)), "retrieved")
    hits = found.select("chunk_id").distinct()
    # only texts of chunks that were found are shuffled
    texts = may_hit(chunks.drop("embedding", "source_type"), hits, F.xxhash64("chunk_id"), hits.count())
    full = found.join(texts, "chunk_id")
    # dealt out by the query once, for the texts of one and for lists of them
    return first_of_equal(full.repartition("query_id"), ["query_id", "text"], ["source_pos", "rank"])


def first_of_equal(rows: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Of rows equal in ``same`` the first in ``order``."""
    return rows.withColumn("_first", F.row_number().over(W.partitionBy(*same).orderBy(*order))).where("_first = 1").drop("_first")


def retrieved_lists(found: DataFrame) -> DataFrame:
    """query_id, retrieved_chunks: the result of ``retrieve`` as one ordered array per query."""
    s = F.struct("source_pos", "rank", "chunk_id", "text", "source_type", "distance", "filename", "page_number", "title", "timestamp_start", "url")
    return found.groupBy("query_id").agg(F.array_sort(F.collect_list(s)).alias("retrieved_chunks"))


def zipped(documents: str, metadatas: str, distances: str, rows: DataFrame, key: str) -> DataFrame:
    """Parallel arrays of a store's answer as rows: key, pos, document, metadata, distance."""
    z = F.arrays_zip(F.col(documents).alias("document"), F.col(metadatas).alias("metadata"), F.col(distances).alias("distance"))
    return rows.select(key, F.posexplode(z).alias("pos", "_z")).select(key, "pos", "_z.*")
