"""The semantic cache as state against a replay by hand."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryspark.streaming import cache, ordered

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "key string, at timestamp, request_id long, clears boolean, embedding array<double>"


def requests():
    r, g = random.Random(4), np.random.default_rng(4)
    spots = g.normal(size=(6, 5))
    rows = []
    for k in range(300):
        v = (spots[r.randrange(6)] + g.normal(size=5) * 0.1).tolist()
        rows.append((f"d{k % 2}", T0 + dt.timedelta(seconds=k * 20 + r.random()), k, r.random() < 0.02, None if r.random() < 0.02 else [0.0] * 5 if r.random() < 0.02 else v))
    return rows


def by_hand(rows, most, threshold, life):
    out, held = [], {}
    for key, at, i, clears, v in sorted(rows, key=lambda x: x[1]):
        entries = [e for e in held.get(key, []) if e[1] > at - dt.timedelta(seconds=life)]
        hit = None
        if clears:
            entries = []
        elif v is not None:
            unit = np.array(v) / (np.linalg.norm(v) or 1)
            best = max(((round(float(e[2] @ unit), 9), -e[0]) for e in entries), default=None)
            if best and np.linalg.norm(v) and best[0] >= threshold:
                hit = (-best[1], best[0])
            else:
                entries = (entries + [(i, at, unit)])[-most:]
        held[key] = entries
        out.append((key, i, *(hit or (None, None))))
    return sorted(out, key=str)


def plain(rows):
    return sorted(((a, b, None if c is None or c != c else int(c), None if d is None or d != d else round(d, 9)) for a, b, c, d in rows), key=str)


@pytest.mark.parametrize("settings", [(200, 0.9, 86_400.0), (2, 0.95, 600.0)])
def test_replay(spark, settings):
    rows = requests()
    got = cache.replayed(spark.createDataFrame(rows, SCHEMA).repartition(4), *settings)
    want = by_hand(rows, *settings)
    assert plain(map(tuple, got.collect())) == want
    assert 20 < sum(r[2] is not None for r in want) < 280


def test_stream_of_late_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    ordered.use_rocksdb(spark)
    r, rows, out = random.Random(1), requests(), []
    arrival = sorted(rows, key=lambda x: x[1] + dt.timedelta(seconds=r.uniform(0, 500)))
    land = tmp_path / "land"
    land.mkdir()
    for n, part in enumerate([arrival[:150], arrival[150:], [("end", T0 + dt.timedelta(days=9), 0, False, None)]]):
        (land / f"{n}.json").write_text("\n".join(json.dumps({"key": a, "at": b.isoformat() + "Z", "request_id": c, "clears": d, "embedding": e}) for a, b, c, d, e in part))
        s = spark.readStream.schema(SCHEMA).json(str(land))
        w = cache.answered(s, 3, 0.95, 900.0).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c"))
        w.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert plain(r for r in out if r[0] != "end") == by_hand(rows, 3, 0.95, 900.0)
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_null_number_leaves_the_others_whole(spark):
    from quarryspark.table_queries import streamed

    big = 1 << 60
    rows = [(k, at, None if i == 17 else big + i, clears, v) for k, at, i, clears, v in requests()]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.col("request_id")).coalesce(1)
    got = plain(map(tuple, streamed(df, lambda s, late: cache.answered(s, 3, 0.95, 900.0, late), cache.RESULT).collect()))
    name = lambda i: None if i in (None, 17) else big + i
    want = [(k, name(i), name(e), near) for k, i, e, near in by_hand(requests(), 3, 0.95, 900.0)]
    assert len(got) == 300 and got == sorted(want, key=str)


def test_a_stream_over_years_is_finished(spark):
    from quarryspark.table_queries import streamed

    rows = [("d", T0 + dt.timedelta(days=10 * k), k, False, [1.0, 0.1 * k]) for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.col("request_id"))
    got = streamed(df, lambda s, late: cache.answered(s, 3, 0.95, 900.0, late), cache.RESULT).collect()
    assert sorted(r["request_id"] for r in got) == list(range(120))
