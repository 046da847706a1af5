"""The relational store where no server can be reached: database files in the folder that the driver and all executors share.

Rows are dealt out by a hash of the first key to ``parts`` files, each a database of its own (SQLite), which one task opens at a time. A step is
one transaction in each file, and a task that is run again finds the step's mark there and does nothing: a step happens once. Filters and
columns of a read go to the databases. It has the steps of ``jdbc_store``; there a step over all rows is one transaction, here it is one a file.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import shared_dir

_TYPES = {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "double": "REAL"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class FileStore:
    def __init__(self, spark: SparkSession, parts: int = 32, batch: int = 1000):
        from pyarrow import fs

        self.spark, self.parts, self.batch = spark, parts, batch
        system, self.root = fs.FileSystem.from_uri(f"{shared_dir(spark)}/database-{uuid.uuid4().hex}")
        if not isinstance(system, fs.LocalFileSystem):
            raise ValueError("set quarryspark.jdbc.url to a database that the driver and all executors reach")
        system.create_dir(self.root, recursive=True)
        self.tables: dict[str, tuple[StructType, list[str]]] = {}

    def create(self, table: str, schema: str | StructType, keys: list[str]) -> None:
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        unknown = {f.dataType.simpleString() for f in schema} - set(_TYPES)
        if unknown:
            raise ValueError(f"no column type for {sorted(unknown)}")
        self.tables[table] = (schema, keys)

    def _step(self, rows: DataFrame, table: str, statement: str) -> int:
        """``statement`` with each of ``rows`` in the file that they belong to; rows changed."""
        schema, keys = self.tables[table]
        columns = [f"{_quoted(f.name)} {_TYPES[f.dataType.simpleString()]}{' NOT NULL' if f.name in keys else ''}" for f in schema]
        made = f"CREATE TABLE IF NOT EXISTS {_quoted(table)} ({', '.join(columns)}, PRIMARY KEY ({', '.join(map(_quoted, keys))}))"
        root, token, size = self.root, uuid.uuid4().hex, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_, new, changed = {}, {}, 0
            try:
                for b in batches:
                    part = b["_part"].to_pylist()
                    for a in range(0, len(part), size):
                        given: dict[int, list[tuple]] = {}
                        for p, *row in zip(part[a : a + size], *(c.slice(a, size).to_pylist() for c in b.columns[1:]), strict=True):
                            given.setdefault(p, []).append(tuple(row))
                        for p, some in given.items():
                            if p not in open_:
                                c = open_[p] = sqlite3.connect(f"{root}/part-{p}", timeout=600, isolation_level=None)
                                c.execute("BEGIN IMMEDIATE")
                                c.execute("CREATE TABLE IF NOT EXISTS steps (token TEXT PRIMARY KEY, changed INTEGER)")
                                new[p] = c.execute("SELECT changed FROM steps WHERE token = ?", (token,)).fetchone()
                                c.execute(made)
                            if new[p] is None:
                                open_[p].executemany(statement, some)
                for p, c in open_.items():
                    if new[p] is None:
                        c.execute("INSERT INTO steps VALUES (?, ?)", (token, c.total_changes))
                        new[p] = c.execute("SELECT changed FROM steps WHERE token = ?", (token,)).fetchone()
                    c.execute("COMMIT")
                    changed += new[p][0]
            finally:
                for c in open_.values():
                    c.close()  # what isn't committed is undone
            yield pa.RecordBatch.from_pydict({"n": pa.array([changed], pa.int64())})

        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(F.col(keys[0]).cast(schema[keys[0]].dataType)), F.lit(self.parts)).cast("int"))
        dealt = dealt.repartition(self.parts, "_part").select("_part", *rows.columns)
        return dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def append(self, rows: DataFrame, table: str) -> None:
        names = rows.columns
        self._step(rows, table, f"INSERT INTO {_quoted(table)} ({', '.join(map(_quoted, names))}) VALUES ({', '.join('?' * len(names))})")

    def upsert(self, rows: DataFrame, table: str, keys: list[str]) -> int:
        """Update rows whose key is there, insert the others; how many."""
        names = rows.columns
        rest = ", ".join(f"{_quoted(c)} = excluded.{_quoted(c)}" for c in names if c not in keys)
        on = f"ON CONFLICT ({', '.join(map(_quoted, keys))}) DO {f'UPDATE SET {rest}' if rest else 'NOTHING'}"
        return self._step(rows, table, f"INSERT INTO {_quoted(table)} ({', '.join(map(_quoted, names))}) VALUES ({', '.join('?' * len(names))}) {on}")

    def delete(self, gone: DataFrame, table: str, keys: list[str]) -> int:
        """Delete rows whose key, with the table's first key in it, is in ``gone``; how many."""
        same = " AND ".join(f"{_quoted(k)} = ?" for k in keys)
        return self._step(gone.select(*keys).distinct(), table, f"DELETE FROM {_quoted(table)} WHERE {same}")

    def read(self, table: str, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """The rows that meet ``where`` (a condition in the databases' SQL), a task a file."""
        schema, _ = self.tables[table]
        kept = StructType([f for f in schema if columns is None or f.name in columns])
        names = ", ".join(_quoted(f.name) for f in kept)
        sql, root, size = f"SELECT {names} FROM {_quoted(table)}" + (f" WHERE {where}" if where else ""), self.root, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import os

            from pyspark.sql.pandas.types import to_arrow_schema

            form = to_arrow_schema(kept)
            for b in batches:
                for p in b["id"].to_pylist():
                    if not os.path.exists(f"{root}/part-{p}"):
                        continue
                    c = sqlite3.connect(f"{root}/part-{p}", timeout=600)
                    found = c.execute(sql)
                    while rows := found.fetchmany(size):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), form.types, strict=True)], schema=form)
                    c.close()

        return self.spark.range(0, self.parts, 1, self.parts).mapInArrow(run, kept)
