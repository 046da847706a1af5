"""Exact nearest neighbours by pivots, for vectors and queries of any number.

Between unit vectors the chord (the square root of twice the cosine distance) is a metric. Each vector lies in the cell of
its nearest pivot, and a cell knows the least and the greatest chord of its vectors to the pivot. By the triangle inequality that
bounds the chord from a query to all vectors of a cell from its chord to the pivot alone, so a query

1. leaves out the cells that lie beyond what the cells' greatest chords and sizes already promise for its k nearest,
2. looks into the nearest cells that have k vectors together,
3. looks into the others only where the bound is no more than the k-th distance found so far.

Queries and vectors meet per cell, and both sides of a cell are dealt out in blocks of bounded size, so a cell with a third of all
vectors, or of all queries, is work of many tasks. A block keeps k rows a query. The pivots (a bounded sample) are
broadcast; so is the table of cells, in slices of bounded size. Neither vectors nor queries pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import drop_stored, stored

#: Pivots; vectors and queries of a block; cells that are sent at once.
PIVOTS, ROWS, ASKED, SENT = 64, 4096, 1024, 200_000
#: Room for the rounding of chords, whose error near 0 is the square root of that of distances.
SLACK = 1e-7


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _chords(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (units @ pivots.T), 0))


def best_of(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` least of each row of ``d``, ties (to 12 digits) by id."""
    d = d.round(12)
    least = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    row, col = np.nonzero(d <= least[:, None])
    at = np.lexsort((pd.factorize(ids, sort=True)[0][col], d[row, col], row))
    row, col = row[at], col[at]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


class PivotIndex:
    """``rows`` (gkey, group, id, embedding, cell, chord), stored, and ``cells`` (gkey, cell, n, least, most)."""

    def __init__(self, vectors: DataFrame, id_col: str, group_col: str, pivots: int = PIVOTS):
        self.id_col, self.group_col = id_col, group_col
        self.types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
        rows = vectors.where("embedding is not null").select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), "embedding")
        sample = rows.orderBy(F.xxhash64("id"), "id").select("embedding").limit(pivots).toPandas()  # at most ``pivots`` rows
        self.pivots = np.unique(_units(sample["embedding"]), axis=0) if len(sample) else np.zeros((0, 0))
        self.pivots = self.pivots[np.linalg.norm(self.pivots, axis=1) > 0]
        sent = vectors.sparkSession.sparkContext.broadcast(self.pivots)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                units = _units(b["embedding"]) if len(b) else np.zeros((0, 0))
                b = b[np.linalg.norm(units, axis=1) > 0]  # vectors without a direction are near to nothing
                if not len(b):
                    continue
                if not len(sent.value):
                    yield b.assign(cell=-1, chord=0.0)
                    continue
                chord = _chords(_units(b["embedding"]), sent.value)
                cell = chord.argmin(axis=1)
                yield b.assign(cell=cell, chord=chord[np.arange(len(b)), cell])

        group, key = self.types[group_col], self.types[id_col]
        found = rows.mapInPandas(assign, f"group {group}, id {key}, embedding {self.types['embedding']}, cell int, chord double")
        gkey = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))
        self.rows = stored(found.withColumn("gkey", gkey), "pivot-rows")
        self.cells = stored(self.rows.groupBy("gkey", "cell").agg(F.count("*").alias("n"), F.min("chord").alias("least"), F.max("chord").alias("most")), "pivot-cells")

    def drop(self) -> None:
        drop_stored(self.rows, self.cells)

    def routes(self, queries: DataFrame, k: int) -> DataFrame:
        """query, gkey, cell, lower (bound of the chord), first: the cells that a query may have to look into.

        ``queries`` has query and embedding.
        """
        spark, kind = queries.sparkSession, queries.schema["query"].dataType.simpleString()
        slices = max(1, -(-self.cells.count() // SENT))
        numbered = self.cells.withColumn("slice", F.pmod(F.xxhash64("gkey"), F.lit(slices)))
        out = None
        for s in range(slices):
            groups: dict[str, list] = {}
            for r in numbered.where(F.col("slice") == s).collect():  # some SENT rows
                groups.setdefault(r["gkey"], []).append((r["cell"], r["n"], r["least"], r["most"]))
            sent = spark.sparkContext.broadcast((self.pivots, {g: tuple(np.array(x) for x in zip(*c, strict=True)) for g, c in groups.items()}))

            def route(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                pivots, groups = sent.value
                for b in batches:
                    for a in range(0, len(b), ASKED):
                        part = b.iloc[a : a + ASKED]
                        units = _units(part["embedding"])
                        blank = np.linalg.norm(units, axis=1) == 0  # as far from all vectors: no cell can be left out
                        chord = _chords(units, pivots) if len(pivots) else np.zeros((len(part), 0))
                        for g, (cell, n, least, most) in groups.items():
                            d = chord[:, cell] if len(pivots) else np.zeros((len(part), len(cell)))
                            lower, upper = np.maximum(np.maximum(d - most, least - d), 0), d + most
                            at = np.argsort(upper, axis=1)
                            enough = np.cumsum(n[at], axis=1) >= k
                            near = np.where(enough.any(axis=1), np.take_along_axis(upper, at, 1)[np.arange(len(d)), enough.argmax(axis=1)], np.inf)
                            at = np.argsort(d, axis=1, kind="stable")
                            sizes = n[at]
                            first = np.zeros(d.shape, bool)
                            np.put_along_axis(first, at, np.cumsum(sizes, axis=1) - sizes < k, 1)
                            first[blank], lower[blank], near[blank] = False, 0, np.inf
                            row, col = np.nonzero(first | (lower <= near[:, None] + SLACK))
                            yield pd.DataFrame({"query": part["query"].to_numpy()[row], "gkey": g, "cell": cell[col], "lower": lower[row, col], "first": first[row, col]})

            part = queries.mapInPandas(route, f"query {kind}, gkey string, cell int, lower double, first boolean")
            out = part if out is None else out.unionByName(part)
        return out

    def _look(self, visits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """query, gkey, group, id, distance: the best ``k`` per block of the cells of ``visits`` (query, gkey, cell)."""
        asked = visits.groupBy("gkey", "cell").agg(F.count("*").alias("asked"))
        sizes = self.cells.join(asked, ["gkey", "cell"]).select("gkey", "cell", F.ceil(F.col("n") / ROWS).cast("int").alias("rows_in"), F.ceil(F.col("asked") / ASKED).cast("int").alias("asked_in"))
        rows = self.rows.join(sizes, ["gkey", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("rows_in")))
        rows = rows.withColumn("ask", F.explode(F.expr("sequence(0L, asked_in - 1L)"))).select("gkey", "cell", "block", "ask", "group", "id", "embedding")
        asks = visits.join(sizes, ["gkey", "cell"]).withColumn("ask", F.pmod(F.xxhash64("query"), F.col("asked_in")))
        asks = asks.withColumn("block", F.explode(F.expr("sequence(0L, rows_in - 1L)"))).join(queries, "query").select("gkey", "cell", "block", "ask", "query", "embedding")

        def best(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(asks):
                return pd.DataFrame({"query": [], "gkey": [], "group": [], "id": [], "distance": []})
            v = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
            d = 1 - (_units(asks["embedding"]) @ v.T) / np.linalg.norm(v, axis=1)
            ids = rows["id"].to_numpy()
            row, col = best_of(d, ids, k)
            return pd.DataFrame({"query": asks["query"].to_numpy()[row], "gkey": rows["gkey"].iloc[0], "group": rows["group"].to_numpy()[col], "id": ids[col], "distance": d[row, col]})

        by = ["gkey", "cell", "block", "ask"]
        kinds = {"query": queries.schema["query"].dataType.simpleString(), "gkey": "string", "group": self.types[self.group_col], "id": self.types[self.id_col], "distance": "double"}
        return rows.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(best, ", ".join(f"{c} {t}" for c, t in kinds.items()))

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """query, group, id, distance, rank: the ``k`` nearest of each group, stored; and the cells looked into (query, gkey, cell), stored.

        ``queries`` has query and embedding.
        """
        queries = queries.where("embedding is not null")
        routes = stored(self.routes(queries, k), "pivot-routes")
        rank = F.row_number().over(W.partitionBy("query", "gkey").orderBy(F.round("distance", 12), "id"))
        found = self._look(routes.where("first"), queries, k).withColumn("rank", rank).where(F.col("rank") <= k)
        found = stored(found, "pivot-first")
        bound = found.groupBy("query", "gkey").agg(F.max("distance").alias("far"), F.count("*").alias("n")).where(F.col("n") >= k).select("query", "gkey", "far")
        open_ = F.col("far").isNull() | (F.pow(F.greatest(F.col("lower") - SLACK, F.lit(0.0)), 2) / 2 <= F.col("far") + 1e-12)
        later = stored(routes.where("not first").join(bound, ["query", "gkey"], "left").where(open_).select("query", "gkey", "cell"), "pivot-later")
        both = found.drop("rank").unionByName(self._look(later, queries, k))
        out = stored(both.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "group", "id", "distance", "rank"), "pivot-found")
        visited = stored(routes.where("first").select("query", "gkey", "cell").unionByName(later), "pivot-visited")
        drop_stored(routes, found, later)
        return out, visited


def nearest_by_pivots(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, group_col: str, query_col: str, pivots: int = PIVOTS) -> DataFrame:
    """query, group, id, distance, rank: the ``k`` nearest rows of each group for each query, ties by id."""
    index = PivotIndex(vectors, id_col, group_col, pivots)
    found, visited = index.search(queries.select(F.col(query_col).alias("query"), "embedding"), k)
    index.drop()
    drop_stored(visited)
    return found.select(F.col("query").alias(query_col), F.col("group").alias(group_col), F.col("id").alias(id_col), "distance", "rank")
