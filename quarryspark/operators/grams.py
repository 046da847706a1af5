"""Texts that contain facts, for facts of any number: an inverted table of character grams, sought by the rarest.

A fact occurs only in texts that have all of its grams of ``SIZE`` characters (a shorter fact is a gram of its own). The
grams of all facts are counted over the texts; each fact is sought by the one that the fewest texts have, and a fact with a
gram that no text has is out. Texts emit the grams of that kind that they have, each once, and meet the facts by
them: in ``SPLIT`` ways, so that a gram which a third of all texts have is the work of many tasks. What meets is verified by the
whole fact. Which grams are any fact's is known to the tasks by a bitmap of fixed size, which errs on the safe side only. Neither
facts nor texts pass the driver, and no task holds all facts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop_stored, stored

SIZE, SPLIT = 8, 16
#: Bits of one row of ``bitmap_construct_agg``, and rows of the bitmap at most (8 MB).
BITS, MAPS = 32768, 2048

_R, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def gram_hashes(text: str, size: int) -> np.ndarray:
    """63-bit hashes of the grams of ``size`` characters at each place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h + codes[k : k + n]) * _R
        h ^= h >> np.uint64(29)
    h = (h + np.uint64(size)) * _M
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(1)).view(np.int64)


def _bitmap(grams: DataFrame, n: int) -> tuple[np.ndarray, list[int]]:
    """Bytes of a bitmap of the hashes of ``grams`` (size, h; some ``n``), and the sizes that occur (SIZE at most)."""
    maps = min(MAPS, max(1, -(-n * 32 // BITS)))
    place = F.pmod(F.col("h"), F.lit(maps * BITS))
    rows = grams.select(place.alias("p")).groupBy(F.floor(F.col("p") / BITS).alias("m")).agg(F.bitmap_construct_agg((F.col("p") % BITS).cast("long")).alias("bits")).collect()
    out = np.zeros((maps, BITS // 8), np.uint8)
    for r in rows:
        out[r["m"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1), sorted(r[0] for r in grams.select("size").distinct().collect())


def _known(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = h % (len(bitmap) * 8)
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def containing_by_grams(texts: DataFrame, facts: DataFrame, text_id: str, fact_id: str, text: str = "text", fact: str = "fact", ignore_case: bool = True) -> DataFrame:
    """(fact_id, text_id) for every text that contains a fact; texts and facts that repeat count each. Stored."""
    spark = texts.sparkSession
    fold = F.lower if ignore_case else (lambda c: c)
    t = texts.where(F.col(text).isNotNull()).select(F.col(text_id).alias("text_id"), fold(F.col(text)).alias("text"))
    t = t.withColumn("row", F.xxhash64("text_id", "text"))
    each = facts.where(F.col(fact).isNotNull() & (F.col(fact) != "")).select(F.col(fact_id).alias("fact_id"), fold(F.col(fact)).alias("fact"))

    def of_facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b["fact"]:
                h = np.unique(gram_hashes(f, size := min(SIZE, len(f))))
                yield pd.DataFrame({"fact": f, "size": size, "h": h})

    grams = stored(each.select("fact").distinct().mapInPandas(of_facts, "fact string, size int, h long"), "fact-grams")

    def scan(wanted: DataFrame, n: int, count: bool) -> DataFrame:
        """(size, h, n): how many texts have grams of ``wanted``, or (row, size, h): which; some that only seem wanted come along."""
        sent = spark.sparkContext.broadcast(_bitmap(wanted, n))

        def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bitmap, sizes = sent.value
            for b in batches:
                for size in sizes:
                    rows, found, held = [], [], 0
                    for row, x in zip(b["row"], b["text"], strict=True):
                        h = gram_hashes(x, size)
                        h = np.unique(h[_known(bitmap, h)])
                        rows.append(np.full(len(h), row))
                        found.append(h)
                        held += len(h)
                        if held > 1_000_000:
                            yield emitted(size, rows, found)
                            rows, found, held = [], [], 0
                    if held:
                        yield emitted(size, rows, found)

        def emitted(size: int, rows: list, found: list) -> pd.DataFrame:
            h = np.concatenate(found)
            if not count:
                return pd.DataFrame({"row": np.concatenate(rows), "size": size, "h": h})
            h, n = np.unique(h, return_counts=True)
            return pd.DataFrame({"size": size, "h": h, "n": n})

        return t.select("row", "text").mapInPandas(of_texts, "size int, h long, n long" if count else "row long, size int, h long")

    counts = scan(grams, grams.count(), True).groupBy("size", "h").agg(F.sum("n").alias("n"))
    rarest = F.min_by(F.struct("size", "h"), F.struct("n", "h"))
    seeds = grams.join(counts, ["size", "h"], "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy("fact").agg(F.min("n").alias("n"), rarest.alias("s"))
    seeds = stored(seeds.where("n > 0").select("fact", "s.size", "s.h", F.xxhash64("fact").alias("number")), "fact-seeds")
    hits = scan(seeds, seeds.count(), False).withColumn("way", F.pmod(F.xxhash64("row"), F.lit(SPLIT)))
    ways = seeds.select("size", "h", "fact", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPLIT - 1).cast("long"))).alias("way"))
    pairs = hits.join(ways, ["size", "h", "way"]).select("row", "fact").distinct()
    found = t.join(pairs, "row").where(F.contains("text", "fact")).select("text_id", "fact")
    out = stored(found.join(each, "fact").select(F.col("fact_id").alias(fact_id), F.col("text_id").alias(text_id)), "facts-found")
    drop_stored(grams, seeds)
    return out
