"""The chunk table in buckets of its sources: a change rewrites only the buckets that hold the sources it names.

Chunks lie in folders by source type and by a hash of their source, so all chunks of a source are in one bucket of its type. Deleting or
replacing sources finds their buckets by the hash, reads these alone (partition pruning), and overwrites those that have
such chunks; Spark commits all of them together. Buckets that nothing is left of are removed afterwards; a change that is stopped
in between can be run again. Files of other buckets are neither read nor moved. What passes the driver are bucket numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHUNKS, conform

BUCKETS = 256


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("source_id")), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], CHUNKS + ", bucket int")
        return self.spark.read.schema(CHUNKS + ", bucket int").parquet(self.path)

    def _write(self, chunks: DataFrame, mode: str) -> None:
        """Each bucket by few tasks, a large one by several."""
        rows = conform(chunks, CHUNKS).withColumn("bucket", self._bucket()).hint("rebalance", "source_type", "bucket")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("source_type", "bucket").parquet(self.path)

    def read(self, source_ids: list[str] | None = None) -> DataFrame:
        """All chunks, or those of the given sources: of their buckets only."""
        rows = self._rows()
        if source_ids is not None:
            ids = self.spark.createDataFrame([(i,) for i in source_ids], "source_id string")
            buckets = [r[0] for r in ids.select(self._bucket()).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("source_id").isin(source_ids))
        return rows.drop("bucket")

    def append(self, chunks: DataFrame) -> None:
        self._write(chunks, "append")

    def delete(self, gone: DataFrame) -> int:
        """Delete all chunks of the sources in ``gone`` (source_id); the number of buckets rewritten, 0 if none has any."""
        return self._change(gone.select("source_id").distinct(), None)

    def replace(self, chunks: DataFrame) -> int:
        """Put ``chunks`` in place of all chunks that their sources have."""
        return self._change(chunks.select("source_id").distinct(), chunks)

    def _change(self, gone: DataFrame, new: DataFrame | None) -> int:
        buckets = [r[0] for r in gone.select(self._bucket().alias("b")).distinct().collect()]  # numbers below ``buckets``
        near = self._rows().where(F.col("bucket").isin(buckets))
        touched = {tuple(r) for r in near.join(gone, "source_id", "left_semi").select("source_type", "bucket").distinct().collect()}
        kept = self._rows().where(self._within(touched)).join(gone, "source_id", "left_anti")
        rows = kept.drop("bucket")
        if new is not None:
            rows = rows.unionByName(conform(new, CHUNKS))
        elif not touched:
            return 0
        left = {tuple(r) for r in kept.select("source_type", "bucket").distinct().collect()}
        if new is not None:
            into = conform(new, CHUNKS).select("source_type", self._bucket().alias("bucket")).distinct()
            into = {tuple(r) for r in into.collect()}
            # a bucket that only gets new sources is overwritten, too: what it has goes along
            other = self._rows().where(self._within(into - touched)).join(gone, "source_id", "left_anti").drop("bucket")
            rows, left = rows.unionByName(other), left | into
        self._write(rows, "overwrite")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for kind, bucket in touched - left:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/source_type={'__HIVE_DEFAULT_PARTITION__' if kind is None else kind}/bucket={bucket}")
            path.getFileSystem(conf).delete(path, True)
        return len(touched | left)

    @staticmethod
    def _within(parts: set[tuple[str, int]]) -> Column:
        """Rows of the given buckets, as a filter of partitions."""
        out = F.lit(False)
        for kind in {k for k, _ in parts}:
            out = out | (F.col("source_type").eqNullSafe(F.lit(kind)) & F.col("bucket").isin([b for k, b in parts if k == kind]))
        return out
