"""Order statistics by counts per value range against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarryspark.operators import evaluation, selection


def wanted(values, p):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    at = p * (len(v) - 1)
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low if low == high or (math.isnan(low) and math.isnan(high)) else low + (high - low) * (at - math.floor(at))


def groups():
    r = random.Random(3)
    inf, nan = float("inf"), float("nan")
    return {
        "all rows": [r.gauss(0, 1) for _ in range(3000)],
        "one far value": [1e300] + [r.random() for _ in range(500)],
        "tiny and huge": [r.choice((-1, 1)) * 10 ** r.uniform(-300, 300) for _ in range(500)],
        "least numbers": [5e-324 * k for k in range(200)] + [-1.7e308, 1.7e308],
        "equal": [2.5] * 700,
        "two": [1.0] * 300 + [math.nextafter(1.0, 2)] * 300,
        "odd": [inf, -inf, nan, nan, 0.0, -0.0, 1.0, -inf],
        "single": [4.0],
        None: [float(k) for k in range(101)],
        "none": [],
    }


@pytest.mark.parametrize("bins,few,sent", [(1024, 4096, 100_000), (4, 2, 0), (2, 1, 3)])
def test_percentiles_equal_sorted_lists(spark, monkeypatch, bins, few, sent):
    for name, x in (("BINS", bins), ("FEW", few), ("SENT", sent)):
        monkeypatch.setattr(selection, name, x)
    rows = [(g, v) for g, vs in groups().items() for v in vs] + [("equal", None), ("none", None)]
    if bins == 2:  # many rounds: fewer rows
        rows = [r for r in rows if r[0] in ("two", "odd", "single", "least numbers", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in selection.percentiles(frame, {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}).collect()}
    assert set(got) == {g for g, v in rows if v is not None}
    for g, r in got.items():
        for p in (0, 50, 95, 99, 100):
            assert str(r[f"p{p}"] + 0.0) == str(wanted(groups()[g], p / 100) + 0.0), (g, p)


def test_latency_is_the_same_either_way(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.expovariate(1)])) for _ in range(2000)] + [("empty", None)]
    frame = spark.createDataFrame(rows, "kind string, ms double")
    plain = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    for by in ([], ["kind"]):
        assert plain(evaluation.latency(frame, "ms", by)) == plain(evaluation.latency(frame, "ms", by, held=0))


def test_a_round_hands_over_counts_only(spark):
    """A group of all rows: the exchange of a round has BINS rows a task at most."""
    rows = spark.range(200_000).select(F.lit("one").alias("g"), F.rand(1).alias("v"))
    got = selection.percentiles(rows, {"p50": 0.5, "p99": 0.99}).first()
    exact = rows.agg(F.percentile("v", F.lit(0.5)), F.percentile("v", F.lit(0.99))).first()
    assert (got["p50"], got["p99"]) == pytest.approx(tuple(exact), abs=1e-12)
