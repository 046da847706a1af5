"""The relational store over JDBC: partitioned reads with pushed filters, batched upserts and deletions.

Reads are dealt out by ranges of a column between its least and greatest value, so each task asks the database for a part of its own; filters and columns go to the database as well. An upsert
writes the rows to a staging table over at most ``connections`` connections, in batches, and then merges it into the table by
one statement in one transaction: a job that fails half way leaves the table as it was. No row passes the driver; it sends statements.

Tables are created from schema strings. Text columns of the key are VARCHAR(``KEY``), others large objects. The merge is
the standard's MERGE.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType, TimestampType

KEY = 255
_TYPES = {LongType: "BIGINT", IntegerType: "INTEGER", ShortType: "SMALLINT", DoubleType: "DOUBLE PRECISION", FloatType: "REAL", BooleanType: "BOOLEAN", DateType: "DATE", TimestampType: "TIMESTAMP"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class JdbcStore:
    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None, connections: int = 8, batch: int = 1000):
        self.spark, self.url, self.connections, self.batch = spark, url, connections, batch
        self.properties = dict(properties or {})

    @contextmanager
    def _connection(self) -> Iterator:
        """A connection of the driver's, for statements; all of them happen or none."""
        jvm = self.spark.sparkContext._jvm
        given = jvm.java.util.Properties()
        for k, v in self.properties.items():
            if k != "driver":
                given.setProperty(k, v)
        if "driver" in self.properties:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.properties["driver"])
        c = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            c.setAutoCommit(False)
            yield c
            c.commit()
        except BaseException:
            c.rollback()
            raise
        finally:
            c.close()

    def execute(self, *statements: str) -> list[int]:
        """Rows changed by each statement; all in one transaction."""
        with self._connection() as c:
            s = c.createStatement()
            try:
                return [s.executeUpdate(x) for x in statements]
            finally:
                s.close()

    def create(self, table: str, schema: str | StructType, keys: list[str]) -> None:
        fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        kinds = {f.name: (f"VARCHAR({KEY})" if f.name in keys else "CLOB") if isinstance(f.dataType, StringType) else _TYPES[type(f.dataType)] for f in fields}
        columns = [f"{_quoted(n)} {t}{' NOT NULL' if n in keys else ''}" for n, t in kinds.items()]
        self.execute(f"CREATE TABLE {_quoted(table)} ({', '.join(columns)}, PRIMARY KEY ({', '.join(map(_quoted, keys))}))")

    def _reader(self, table: str):
        r = self.spark.read.format("jdbc").option("url", self.url).option("dbtable", _quoted(table)).option("fetchsize", self.batch)
        for k, v in self.properties.items():
            r = r.option(k, v)
        return r

    def read(self, table: str, by: str | None = None, partitions: int = 8) -> DataFrame:
        """The table; dealt out by ranges of ``by`` (a number, a date or a time) where given."""
        if by is None:
            return self._reader(table).load()
        ends = self._reader(table).load().agg(F.min(by), F.max(by)).first()
        if ends[0] is None or ends[0] == ends[1]:
            return self._reader(table).load()
        return self._reader(table).option("partitionColumn", _quoted(by)).option("lowerBound", str(ends[0])).option("upperBound", str(ends[1])).option("numPartitions", partitions).load()

    def append(self, rows: DataFrame, table: str) -> None:
        w = rows.coalesce(self.connections) if rows.rdd.getNumPartitions() > self.connections else rows
        w = w.write.format("jdbc").option("url", self.url).option("dbtable", _quoted(table)).option("batchsize", self.batch)
        for k, v in self.properties.items():
            w = w.option(k, v)
        w.mode("append").save()

    @contextmanager
    def _staged(self, rows: DataFrame, keys: list[str]) -> Iterator[str]:
        """The name of a table with ``rows``; of rows equal in the key, which would be ambiguous, the database refuses the second."""
        stage = f"stage_{uuid.uuid4().hex}"
        self.create(stage, rows.schema, keys)
        try:
            self.append(rows, stage)
            yield stage
        finally:
            self.execute(f"DROP TABLE {_quoted(stage)}")

    def upsert(self, rows: DataFrame, table: str, keys: list[str]) -> int:
        """Update rows whose key is there, insert the others; how many."""
        rest = [c for c in rows.columns if c not in keys]
        same = " AND ".join(f"t.{_quoted(k)} = s.{_quoted(k)}" for k in keys)
        update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{_quoted(c)} = s.{_quoted(c)}' for c in rest)}" if rest else ""
        names, values = ", ".join(map(_quoted, rows.columns)), ", ".join(f"s.{_quoted(c)}" for c in rows.columns)
        with self._staged(rows, keys) as stage:
            return self.execute(f"MERGE INTO {_quoted(table)} t USING {_quoted(stage)} s ON {same}{update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})")[0]

    def delete(self, gone: DataFrame, table: str, keys: list[str]) -> int:
        """Delete rows whose key is in ``gone``; how many."""
        same = " AND ".join(f"s.{_quoted(k)} = {_quoted(table)}.{_quoted(k)}" for k in keys)
        with self._staged(gone.select(*keys).distinct(), keys) as stage:
            return self.execute(f"DELETE FROM {_quoted(table)} WHERE EXISTS (SELECT 1 FROM {_quoted(stage)} s WHERE {same})")[0]


def has_database(spark: SparkSession) -> bool:
    """Whether ``local_database`` knows a database that all tasks reach; see ``file_store`` for where none is."""
    master = spark.sparkContext.master
    return bool(spark.conf.get("quarryspark.jdbc.url", None)) or (master.startswith("local") and not master.startswith("local-cluster"))


def local_database(spark: SparkSession, name: str) -> str:
    """The URL of the session's database (``quarryspark.jdbc.url``), or where all tasks run in this process, of one in its memory."""
    url = spark.conf.get("quarryspark.jdbc.url", None)
    if url:
        return url
    if not has_database(spark):
        raise ValueError("set quarryspark.jdbc.url to a database that the driver and all executors reach")
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.field", "java.lang.System.err")
    return f"jdbc:derby:memory:{name};create=true"
