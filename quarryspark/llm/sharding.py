"""Operator 9, sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get their number in the order of (doc_id, size, text_crc32): a range exchange of those thin columns,
a sort within partitions and one offset per partition; no row passes through a single task. Rows equal in
all three are interchangeable, so the result depends on the data only, not on the partitioning.
What passes the driver is a sample for the bounds of the ranges, which Spark keeps under a million keys, and a count per
partition.

The row number r of N rows goes through a keyed Feistel network over Z_a x Z_b with a = ceil(sqrt N) and
b = ceil(N / a), so the domain exceeds N by less than a. A value of N or more is put through the network
again (cycle walking) until it is below N; that makes a permutation p of 0..N-1. Then
shard = p(r) mod n_shards and slot = p(r) div n_shards: counts differ by one at most, slots have no gaps,
and anyone who knows N, the seed and r can compute both without reading the data.

Defined cases: null text has size 1 and the checksum of no bytes; null doc_ids come first; repeated rows each
get a place of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

ROUNDS, SEED, WALKS = 6, 20240229, 64


def feistel(x: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The image of row number ``x`` under the permutation of 0..n-1."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def network(v: Column) -> Column:
        start = F.struct((v % a).alias("l"), F.floor(v / a).cast("long").alias("r"))

        def turn(s: Column, j: Column) -> Column:
            m = F.when(j % 2 == 1, F.lit(a).cast("long")).otherwise(F.lit(b).cast("long"))
            return F.struct(s["r"].alias("l"), ((s["l"] + F.pmod(F.xxhash64(s["r"], j, F.lit(seed)), m)) % m).alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: s["r"] * a + s["l"])

    walks = min(WALKS, a * b - n + 1)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, walks))), network(x), lambda v, _: F.when(v < n, v).otherwise(network(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def numbered(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` from 0 in the order of ``keys``, and the count of rows."""
    tie = F.xxhash64(F.monotonically_increasing_id())  # deals out rows that are equal in all keys
    ranged = rows.withColumn("_tie", tie).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys).drop("_tie")
    kept = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = [(r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()]  # one row per partition
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    small = rows.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return kept.join(F.broadcast(small), "_part").withColumn("row_number", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"), before


def shard(docs: DataFrame, n_shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot: one row per row of ``docs``."""
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows, n = numbered(thin, ["doc_id", "size", "text_crc32"])
    rows = rows.withColumn("_p", feistel(F.col("row_number"), n, seed))
    return rows.select("doc_id", "size", "text_crc32", "row_number", (F.col("_p") % n_shards).cast("int").alias("shard"), F.floor(F.col("_p") / n_shards).cast("long").alias("slot"))


def op9_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
