"""Exact order statistics of large groups by counts per value range.

A wanted rank lies in a known interval of values, at first the whole group. A round counts the rows of each interval in ``BINS``
ranges of it (map-side partial counts, so a group of any size costs a task BINS numbers) and goes on with the range that
holds the rank, from the least to the greatest value that it has. Ranges are even on a logarithmic scale and on the
plain scale by turns: one far value doesn't spoil them, and the ends of an interval always part. Intervals of one value are
done; those of at most ``FEW`` rows are sorted. No task ever holds a group's rows or distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import drop_stored, stored

BINS, FEW = 1024, 4096
#: Intervals that are broadcast; more are joined by their group.
SENT = 100_000


def _place(v: Column, low: Column, high: Column, logarithmic: bool) -> Column:
    """The number of the range of [low, high] that ``v`` lies in; it never falls as ``v`` rises."""
    if logarithmic:
        v, low, high = (F.signum(x) * F.log1p(F.abs(x)) for x in (v, low, high))
    width = high - low
    part = F.when(width <= 0, 0.0).when(width < float("inf"), F.try_divide(v - low, width)).otherwise(F.try_divide(v / 2 - low / 2, high / 2 - low / 2))
    return F.least(F.lit(BINS - 1), F.floor(F.coalesce(part, F.lit(0.0)) * BINS).cast("int"))


def order_statistics(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """g, rank, value: the value of each wanted rank (from 0) of its group, stored.

    ``values`` has g and v (double; nulls aren't counted, infinities and NaN stand at the ends), ``ranks`` g and rank. ``g`` is of any type.
    """
    # kind: -inf, number, inf, NaN, in this order
    v = F.col("v")
    kind = F.when(F.isnan(v), 3).when(v == float("inf"), 2).when(v == float("-inf"), 0).otherwise(1)
    rows = values.where(v.isNotNull()).select("g", kind.alias("kind"), F.when(kind == 1, v + 0.0).otherwise(0.0).alias("v"))
    kinds = rows.groupBy("g", "kind").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("kind").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kinds = kinds.withColumn("before", before)
    wanted = ranks.select(F.col("g").alias("of"), "rank").distinct()
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    open_ = stored(wanted.join(kinds, F.col("of").eqNullSafe(F.col("g")) & inside).select("g", "rank", "kind", "low", "high", "n", "before"), "ranks")
    interval = ["g", "kind", "low", "high"]

    def members(intervals: DataFrame) -> DataFrame:
        """v of the rows of each of ``intervals``, as own_v beside their columns."""
        i = intervals.select(*[F.col(c).alias(f"i_{c}") for c in interval]).distinct()
        i = F.broadcast(i) if i.count() <= SENT else i
        own = F.col("g").eqNullSafe(F.col("i_g")) & (F.col("kind") == F.col("i_kind")) & F.col("v").between(F.col("i_low"), F.col("i_high"))
        return rows.join(i, own).select(*[F.col(f"i_{c}").alias(c) for c in interval], F.col("v").alias("own_v"))

    turn = 0
    while not (large := open_.where((F.col("low") < F.col("high")) & (F.col("n") > FEW))).isEmpty():
        bins = members(large).withColumn("bin", _place(F.col("own_v"), F.col("low"), F.col("high"), turn % 2 == 0))
        bins = bins.groupBy(*interval, "bin").agg(F.count("*").alias("m"), F.min("own_v").alias("a"), F.max("own_v").alias("b"))
        bins = bins.withColumn("less", F.coalesce(F.sum("m").over(W.partitionBy(*interval).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        bins = bins.select(*[F.col(c).alias(f"i_{c}") for c in interval], "m", "a", "b", "less")
        same = F.col("g").eqNullSafe(F.col("i_g")) & (F.col("kind") == F.col("i_kind")) & (F.col("low") == F.col("i_low")) & (F.col("high") == F.col("i_high"))
        at = F.col("rank") - F.col("before")
        narrowed = large.join(bins, same & (at >= F.col("less")) & (at < F.col("less") + F.col("m")))
        narrowed = narrowed.select("g", "rank", "kind", F.col("a").alias("low"), F.col("b").alias("high"), F.col("m").alias("n"), (F.col("before") + F.col("less")).alias("before"))
        rest = open_.where((F.col("low") == F.col("high")) | (F.col("n") <= FEW))
        open_, old = stored(narrowed.unionByName(rest), "ranks"), open_
        drop_stored(old)
        turn += 1
    done = open_.where("low = high").select("g", "rank", "kind", F.col("low").alias("v"))
    few = open_.where("low < high")
    if not few.isEmpty():  # at most FEW rows an interval
        order = members(few).withColumn("nth", F.row_number().over(W.partitionBy(*interval).orderBy("own_v")) - 1)
        order = order.select(*[F.col(c).alias(f"i_{c}") for c in interval], "own_v", "nth")
        same = F.col("g").eqNullSafe(F.col("i_g")) & (F.col("kind") == F.col("i_kind")) & (F.col("low") == F.col("i_low")) & (F.col("high") == F.col("i_high"))
        found = few.join(order, same & (F.col("nth") == F.col("rank") - F.col("before"))).select("g", "rank", "kind", F.col("own_v").alias("v"))
        done = done.unionByName(found)
    value = F.when(F.col("kind") == 0, float("-inf")).when(F.col("kind") == 1, F.col("v")).when(F.col("kind") == 2, float("inf")).otherwise(float("nan"))
    out = stored(done.select("g", "rank", value.alias("value")), "order-statistics")
    drop_stored(open_)
    return out


def percentiles(values: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """g and a column per entry of ``wanted`` (name: share of 0 to 1), with linear interpolation. ``values`` has g and v (double)."""
    sizes = stored(values.groupBy("g").agg(F.count("v").alias("n")).where("n > 0"), "sizes")
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in wanted.items()}
    both = F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)])
    found = order_statistics(values, sizes.select("g", F.explode(both).alias("rank")))
    lists = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")).withColumnRenamed("g", "of")
    out = sizes.join(lists, F.col("g").eqNullSafe(F.col("of")))

    def between(x: Column) -> Column:
        low, high, part = F.col("at")[F.floor(x).cast("long")], F.col("at")[F.ceil(x).cast("long")], x - F.floor(x)
        return F.when(low == high, low).otherwise(low + (high - low) * part)

    return out.select("g", *[between(x).alias(name) for name, x in at.items()])
