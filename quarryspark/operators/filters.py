"""Bitmap filters: rows that certainly have no partner leave before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of ``bitmap_construct_agg``, and the bound of a broadcast filter (8 MB).
BITMAP_BITS, MAX_BITMAPS = 32768, 2048


def mark_hit(rows: DataFrame, hits: DataFrame, key: Column, n_hits: int, hit_key: Column | None = None) -> DataFrame:
    """``rows`` with ``_hit``: false only where ``key`` (a long of both frames, or ``hit_key`` of ``hits``) is certainly none of ``hits``.

    A bitmap filter of 64 bits a hit, up to a fixed size; beyond that it says true more often. ``rows`` has no columns of
    names that begin with an underscore.
    """
    maps = min(MAX_BITMAPS, max(1, -(-n_hits * 64 // BITMAP_BITS)))
    place = F.pmod(key, F.lit(maps * BITMAP_BITS))
    bits = hits.select((place if hit_key is None else F.pmod(hit_key, F.lit(maps * BITMAP_BITS))).alias("_p")).groupBy(F.floor(F.col("_p") / BITMAP_BITS).alias("_b")).agg(F.bitmap_construct_agg((F.col("_p") % BITMAP_BITS).cast("long")).alias("_bits"))
    marked = rows.withColumn("_p", place).withColumn("_m", F.floor(F.col("_p") / BITMAP_BITS))
    marked = marked.join(F.broadcast(bits), F.col("_m") == F.col("_b"), "left")  # at most MAX_BITMAPS rows of 4 kB
    byte = "cast(conv(hex(substring(_bits, cast((_p % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    return marked.withColumn("_hit", F.expr(f"coalesce(shiftright({byte}, cast(_p % 8 as int)) & 1 = 1, false)")).select(*rows.columns, "_hit")


def may_hit(rows: DataFrame, hits: DataFrame, key: Column, n_hits: int) -> DataFrame:
    """Rows of ``rows`` whose ``key`` may be one of ``hits``; none that is gets lost."""
    return mark_hit(rows, hits, key, n_hits).where("_hit").drop("_hit")
