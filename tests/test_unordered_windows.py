"""A stream of shuffled batches gives the windows of the ordered whole."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from quarryspark.operators import chunking
from quarryspark.streaming import ordered, windows

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "key string, at timestamp, pos long, duration double, text string"


def run(spark, land, out, check):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(land))
    w = windows.unordered_windows(s, 60.0, "5 minutes").writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(check))
    w.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_shuffled_batches_give_the_batch_result(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    ordered.use_rocksdb(spark)
    r = random.Random(2)
    rows = []
    for k in range(240):
        at = r.uniform(0, 3600)
        rows.append((f"v{k % 3}", T0 + dt.timedelta(seconds=round(at, 3)), k, r.choice([None, 1.0, 30.0]), f"w{k}" if k % 11 else None))
    # up to 4 minutes late, over batches
    arrival = sorted(rows, key=lambda x: (x[1] + dt.timedelta(seconds=r.uniform(0, 240))))
    end = ("end", T0 + dt.timedelta(hours=5), 0, None, "x")
    land, out = tmp_path / "land", []
    land.mkdir()
    for n, part in enumerate([arrival[:100], arrival[100:170], arrival[170:], [end]]):
        lines = [json.dumps({"key": a, "at": b.isoformat() + "Z", "pos": c, "duration": d, "text": e}) for a, b, c, d, e in part]
        r.shuffle(lines)
        (land / f"{n}.json").write_text("\n".join(lines))
        run(spark, land, out, tmp_path / "check")  # stopped and started again behind each batch
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("start", F.unix_micros("at") / 1e6).withColumn("order", F.struct("at", "pos"))
    want = chunking.duration_windows(frame, ["key"], 60.0, "order").collect()
    assert sorted(out) == sorted(map(tuple, want)) and len(out) > 30
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
