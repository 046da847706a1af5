"""Operator 5, exact dedup: a log-structured merge index of text digests.

* **Memtable flush.** Each task sorts the (digest, identifier) pairs of its share, its memtable, and writes them as
  one sorted run: level 0 has as many runs as the flush has tasks, whose digests overlap. Parquet keeps a Bloom
  filter and min/max of the digest per run.
* **Compaction.** Runs merge into one level of sorted runs with disjoint ranges of digests: per digest one identifier
  stays (``keep`` says the smallest or the largest) with the number of rows. A map-side partial aggregate takes hot
  digests apart. More flushes may follow and be compacted with what is there.
* **Look-up.** Digests are looked up in the compacted level: a bitmap filter of its digests that several rows have lets
  most rows through without a look, and the rest join it, hot digests by broadcast.
* **Byte verification.** A digest hit is only a candidate. A fixed-size bitmap filter of the digests that
  were hit lets a second scan drop nearly every text without copies; what is left is compared byte for byte
  (``min(text) = max(text)`` per digest, again with map-side partials, so a group of any size sends one
  text per task). Digests with different texts, should any exist, are regrouped by the text itself.

All steps are DataFrame operations; no Python runs on the executors.

Defined cases: null text counts as the empty text, all such rows are one group; rows that repeat both
``doc_id`` and text share their verdict; a null ``doc_id`` is smaller than any number; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import left_join_groups, lower_ascii, may_hit, shared_dir, stored, table


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, text (normalised)."""
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


class DigestIndex:
    """Runs of (digest, doc_id, n) under one shared folder. ``flush`` adds a level-0 run, ``compact`` merges."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "largest"):
        self.spark, self.keep, self.runs = spark, keep, []
        self.path = path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"

    def flush(self, docs: DataFrame) -> None:
        rows = digests(docs).select("digest", "doc_id", F.lit(1).cast("long").alias("n"))
        self._write(rows, f"{self.path}/L0-{uuid.uuid4().hex}")

    def _write(self, rows: DataFrame, path: str) -> None:
        """Each partition of ``rows`` as one sorted run."""
        rows.sortWithinPartitions("digest", "doc_id").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
        self.runs.append(path)

    def look_up(self, docs: DataFrame) -> DataFrame:
        """doc_id and keep_id of those of ``docs`` whose digest the index has, behind a bitmap filter of it."""
        there = self.merged()
        new = digests(docs).select("doc_id", "digest")
        return may_hit(new, there, F.xxhash64("digest"), there.count()).join(there, "digest").select("doc_id", "digest", "keep_id")

    def read(self) -> DataFrame:
        return self.spark.read.schema("digest binary, doc_id long, n long").parquet(*self.runs)

    def merged(self) -> DataFrame:
        """digest, keep_id, group_size of all runs."""
        best = F.max("doc_id") if self.keep == "largest" else F.min("doc_id")
        return self.read().groupBy("digest").agg(best.alias("keep_id"), F.sum("n").alias("group_size"))

    def compact(self) -> None:
        """Replace all runs by one level of disjoint ranges: per digest the kept identifier and the row count."""
        rows = self.merged().select("digest", F.col("keep_id").alias("doc_id"), F.col("group_size").alias("n"))
        self.runs, old = [], self.runs
        self._write(rows.repartitionByRange("digest"), f"{self.path}/L1-{len(old)}-{uuid.uuid4().hex[:8]}")


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    spark = docs.sparkSession
    index = DigestIndex(spark, keep=keep)
    index.flush(docs)
    entries = index.read()
    index.compact()
    level = index.read()  # a digest once
    groups = level.where("n > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    total, n_hits = entries.count(), groups.count()

    seen = may_hit(digests(docs), groups, F.xxhash64("digest"), n_hits).groupBy("digest").agg((F.min("text") != F.max("text")).alias("differ"))
    collided = stored(seen.where("differ").select("digest"), "digest-collisions")
    rows = entries.select("doc_id", "digest")
    if not collided.isEmpty():  # one digest for several texts: those rows are grouped by text
        best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
        odd = digests(docs).join(collided, "digest", "left_semi")
        exact = odd.groupBy("digest", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        odd = odd.join(exact, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
        rows, groups = rows.join(collided, "digest", "left_anti"), groups.join(collided, "digest", "left_anti")
    else:
        odd = None
    out = left_join_groups(rows, groups, "digest", "group_size", total)
    out = out.select("doc_id", "digest", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    if odd is not None:
        out = out.unionByName(odd)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha
  FROM documents),
g AS (SELECT sha, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY sha)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.sha AS text_sha256
FROM d JOIN g ON d.sha = g.sha
"""
