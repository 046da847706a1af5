"""Server-sent events as a streaming source: files that grow, read from where the last batch ended.

Each file of a folder is one stream of frames, appended to as the answer comes, and may be cut anywhere: within a frame, a
line, a character. An offset is the size of each file. A line belongs to the batch in whose range its line end lies; where its
beginning lies before, the reader goes back to it. So a batch is a function of its two offsets: run again after a failure it
gives the same rows, and no parser's state has to be kept. ``answer_parts`` then drops what follows a stream's end, by a stateful processor.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from .sse import DONE, ERROR

LINES = "stream string, pos long, data string"
#: Bytes that are read at once, and tasks of a batch at most.
STEP, TASKS = 1 << 16, 64


def lines_between(read, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines whose ends lie in [start, end); ``read(at, n)`` gives bytes."""
    begin = start
    while begin > 0:  # back to the beginning of the line that ``start`` stands in
        at = max(0, begin - STEP)
        cut = read(at, begin - at).rfind(b"\n")
        if cut >= 0:
            begin = at + cut + 1
            break
        begin = at
    at, rest = begin, b""
    while at < end:
        part = read(at, min(STEP, end - at))
        if not part:
            break
        at += len(part)
        rest += part
        *whole, rest = rest.split(b"\n")
        for line in whole:
            yield begin, line
            begin += len(line) + 1


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class FramesReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, path = self._folder()
        return {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.size and not f.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[_Ranges]:
        """What has come to each file; the files dealt out to tasks by what has come."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(min(TASKS, max(1, len(end))))]
        sizes = [0] * len(out)
        for name, size in sorted(end.items(), key=lambda f: -(f[1] - start.get(f[0], 0))):
            if size > start.get(name, 0):
                least = sizes.index(min(sizes))
                out[least].append((name, start.get(name, 0), size))
                sizes[least] += size - start.get(name, 0)
        return [_Ranges(r) for r in out if r] or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        system, folder = self._folder()
        for name, start, end in partition.ranges:
            with system.open_input_file(f"{folder}/{name}") as f:
                for at, line in lines_between(lambda a, n, f=f: f.read_at(n, a), start, end):
                    text = line.decode("utf-8", "replace")
                    if text.startswith("data: "):
                        yield name, at, text[6:]


class Frames(DataSource):
    """``sse_frames``: the data lines of all files under ``path``, by file and place."""

    @classmethod
    def name(cls):
        return "sse_frames"

    def schema(self):
        return LINES

    def streamReader(self, schema):
        return FramesReader(self.options)


class _Answers(StatefulProcessor):
    """Data up to a stream's end; an error line fails the job unless the stream has ended before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            return
        new = pd.concat(list(rows)).sort_values("pos")
        out = []
        for pos, data in zip(new["pos"], new["data"], strict=True):
            if data.strip() == DONE:
                self.ended.update((True,))
                break
            if data.startswith(ERROR):
                raise RuntimeError(f"stream {key[0]}: {data}")
            out.append((key[0], pos, data))
        yield pd.DataFrame(out, columns=["stream", "pos", "data"])

    def close(self) -> None:
        pass


def frames_stream(spark: SparkSession, path: str) -> DataFrame:
    """LINES as files under ``path`` grow."""
    spark.dataSource.register(Frames)
    return spark.readStream.format("sse_frames").option("path", path).load()


def answer_parts(lines: DataFrame) -> DataFrame:
    """LINES of a stream up to the end of each answer. Needs ``ordered.use_rocksdb``."""
    return lines.groupBy("stream").transformWithStateInPandas(_Answers(), LINES, "Append", "None")
