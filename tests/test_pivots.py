"""Nearest neighbours by pivots against all pairs, and that cells are left out."""

import numpy as np
import pytest

from quarryspark.operators import pivots, retrieve

SCHEMA = "chunk_id long, source_type string, embedding array<float>"


def by_hand(vectors, queries, k):
    out = []
    for q, e in queries:
        if e is None:
            continue
        e = np.array(e, float)
        e = e / (np.linalg.norm(e) or 1)
        groups = {}
        for i, g, v in vectors:
            if v is not None and np.linalg.norm(np.array(v, np.float32)):
                v = np.array(np.array(v, np.float32), float)
                groups.setdefault(g, []).append((round(1 - float(e @ v) / np.linalg.norm(v), 9), i))
        out += [(q, g, i, rank) for g, rows in groups.items() for rank, (_, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(7)
    spots = r.normal(size=(30, 6))
    return [(i, ("pdf", "web", None)[i % 3], (spots[i % 30] + r.normal(size=6) * 0.02).tolist()) for i in range(3000)]


def test_cells_are_left_out_and_nothing_is_lost(spark, clustered):
    vectors = spark.createDataFrame(clustered, SCHEMA).repartition(4)
    queries = [(i, clustered[i][2]) for i in range(0, 3000, 100)]
    index = pivots.PivotIndex(vectors, "chunk_id", "source_type", 32)
    found, visited = index.search(spark.createDataFrame(queries, "query long, embedding array<float>"), 5)
    got = sorted(((r["query"], r["group"], r["id"], r["rank"]) for r in found.collect()), key=str)
    assert got == by_hand(clustered, queries, 5)
    all_cells, looked = index.cells.count() * len(queries), visited.count()
    assert looked == visited.distinct().count() and looked < all_cells / 4
    index.drop()


@pytest.mark.parametrize("k,rows,asked", [(1, 7, 3), (4, 50, 2), (4000, 500, 100)])
def test_blocks_ties_blanks_and_few_rows(spark, clustered, monkeypatch, k, rows, asked):
    monkeypatch.setattr(pivots, "ROWS", rows)
    monkeypatch.setattr(pivots, "ASKED", asked)
    monkeypatch.setattr(pivots, "SENT", 3)
    same = clustered[0][2]
    vectors = clustered[:300] + [(5000 - i, "hot", same) for i in range(200)] + [(6000, "pdf", None), (6001, "pdf", [0.0] * 6), (6002, "one", [1.0] * 6)]
    queries = [(1, same), (2, [0.0] * 6), (3, None), (4, clustered[17][2]), (5, same), (6, (-np.array(same)).tolist())]
    found = pivots.nearest_by_pivots(spark.createDataFrame(vectors, SCHEMA), spark.createDataFrame(queries, "query_id long, embedding array<float>"), k, "chunk_id", "source_type", "query_id")
    assert sorted(((r["query_id"], r["source_type"], r["chunk_id"], r["rank"]) for r in found.collect()), key=str) == by_hand(vectors, queries, k)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "query_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    vectors = spark.createDataFrame([(1, "web", [1.0, 1.0])], SCHEMA)
    for v, q in ((vectors, none), (vectors.limit(0), one), (vectors.where("chunk_id = 2"), none)):
        assert pivots.nearest_by_pivots(v, q, 3, "chunk_id", "source_type", "query_id").count() == 0


def test_many_queries_take_the_pivots(spark, clustered, monkeypatch):
    vectors = spark.createDataFrame(clustered[:400], SCHEMA)
    queries = spark.createDataFrame([(i, clustered[i][2]) for i in range(40)], "query_id long, embedding array<float>")
    few = retrieve.nearest(vectors, queries, 3).select("query_id", "source_type", "chunk_id", "rank")
    few = sorted(map(tuple, few.collect()), key=str)
    monkeypatch.setattr(retrieve, "BLOCK", 10)
    many = retrieve.nearest(vectors, queries, 3).select("query_id", "source_type", "chunk_id", "rank")
    assert sorted(map(tuple, many.collect()), key=str) == few
