"""Equal distances: a task keeps k rows a query, and the ids decide."""

import numpy as np
import pytest

from quarryspark.operators import retrieve


@pytest.mark.parametrize("ids", [np.arange(300), np.array([f"v{i}" for i in range(300)], object)])
def test_least_of_ties_is_k_rows_by_id(ids):
    r = np.random.default_rng(3)
    ids = r.permutation(ids)
    d = r.integers(0, 4, (20, 300)).astype(float)
    d[0] = 1.0
    want = [sorted(zip(row, ids, strict=True))[:5] for row in d.tolist()]
    a = retrieve._least(d, ids, 5)
    first, second = retrieve._least(d[:, :150], ids[:150], 5), retrieve._least(d[:, 150:], ids[150:], 5)
    b = retrieve._least(np.hstack([first[0], second[0]]), np.hstack([first[1], second[1]]), 5)
    for got in (a, b):
        assert got[0].shape == (20, 5) and [list(zip(*x, strict=True)) for x in zip(got[0].tolist(), got[1].tolist(), strict=True)] == want


def test_a_zero_query_keeps_k_rows_a_task(spark):
    rows = spark.createDataFrame([(i, 0, [1.0, float(i % 3)]) for i in range(999, -1, -1)], "id long, g int, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "q long, embedding array<double>")
    got = retrieve.nearest(rows, queries, 5, "id", "g", "q")
    assert {(r["q"], r["id"], r["rank"]) for r in got.collect()} == {(1, i, i + 1) for i in range(5)} | {(2, 3 * i, i + 1) for i in range(5)}
