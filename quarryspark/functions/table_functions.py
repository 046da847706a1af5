"""Chunking as table functions of SQL.

``register`` gives a session

* ``split_text(text [, kind [, size [, overlap]]])``, to be called by LATERAL: chunk_in_segment, char_start, text of each chunk. What the
  row in front of it says (source, page, heading) stays with its chunks.
* ``time_windows(TABLE(segments), by, limit)``: the greedy duration windows of each value of the column ``by``. ``analyze`` reads the
  table's columns, so the result has that column with its own type, and asks Spark for the rows by ``by``, ordered by at
  and pos: a table needs no PARTITION BY and no ORDER BY of the caller's.
* ``windows_of(TABLE(segments) PARTITION BY ... ORDER BY (..., ...), limit)``: the same where the caller's clauses say what belongs together.

Segments have at (seconds), duration and text. Rows stream; one window is held.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from ..operators.chunking import OVERLAP, PDF_SEPARATORS, SIZE, WEB_SEPARATORS, split_text

_KINDS = {"pdf": PDF_SEPARATORS, "web": WEB_SEPARATORS}


class SplitText:
    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument | None = None, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, StringType):
            raise ValueError("split_text takes a text")
        if kind is not None and (not kind.isConstantExpression or kind.value not in _KINDS):
            raise ValueError(f"the kind of a text is one of {', '.join(_KINDS)}")
        return AnalyzeResult(StructType([StructField("chunk_in_segment", IntegerType()), StructField("char_start", IntegerType()), StructField("text", StringType())]))

    def eval(self, text: str, kind: str = "pdf", size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple]:
        if text is not None:
            for n, (chunk, at) in enumerate(split_text(text, _KINDS[kind], size, overlap)):
                yield n, at, chunk


_WINDOW = [StructField("chunk_index", IntegerType()), StructField("text", StringType()), StructField("timestamp_start", LongType()), StructField("timestamp_end", LongType())]


def _columns(table: AnalyzeArgument, *names: str) -> StructType:
    if not table.isTable:
        raise ValueError("a table of segments is needed")
    missing = [n for n in names if n not in table.dataType.fieldNames()]
    if missing:
        raise ValueError(f"the segments lack {', '.join(missing)}")
    return table.dataType


class _Fold:
    """One partition's segments in order."""

    def __init__(self):
        self.n, self.texts, self.start, self.end = 0, [], None, None

    def closed(self) -> tuple:
        return self.n, " ".join(self.texts), round(self.start), round(self.end)

    def add(self, row: Row, limit: float) -> Iterator[tuple]:
        stop = row["at"] + (row["duration"] or 0.0)
        if self.texts and stop - self.start >= limit:
            yield self.closed()
            self.n, self.texts = self.n + 1, []
        if not self.texts:
            self.start = row["at"]
        self.texts.append(row["text"] or "")
        self.end = stop


class WindowsOf:
    def __init__(self):
        self.fold = _Fold()

    @staticmethod
    def analyze(table: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        _columns(table, "at", "duration", "text")
        return AnalyzeResult(StructType(_WINDOW))

    def eval(self, row: Row, limit: float) -> Iterator[tuple]:
        yield from self.fold.add(row, float(limit))

    def terminate(self) -> Iterator[tuple]:
        if self.fold.texts:
            yield self.fold.closed()


class TimeWindows:
    def __init__(self):
        self.fold, self.key = _Fold(), None

    @staticmethod
    def analyze(table: AnalyzeArgument, by: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if not by.isConstantExpression:
            raise ValueError("the column of the sources is named by a constant")
        columns = _columns(table, by.value, "at", "pos", "duration", "text")
        return AnalyzeResult(StructType([columns[by.value], *_WINDOW]), partitionBy=[PartitioningColumn(by.value)], orderBy=[OrderingColumn("at"), OrderingColumn("pos")])

    def eval(self, row: Row, by: str, limit: float) -> Iterator[tuple]:
        self.key = row[by]
        for w in self.fold.add(row, float(limit)):
            yield self.key, *w

    def terminate(self) -> Iterator[tuple]:
        if self.fold.texts:
            yield self.key, *self.fold.closed()


def register(spark: SparkSession) -> None:
    for name, cls in (("split_text", SplitText), ("windows_of", WindowsOf), ("time_windows", TimeWindows)):
        spark.udtf.register(name, UserDefinedTableFunction(cls, returnType=None, name=name))
