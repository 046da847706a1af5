"""Rows of an unordered stream in order, per key: the base of stateful processors that depend on the order.

Keys are dealt to ``LANES`` lanes, whose state is kept together: a call to the state store for each key and each row would cost more than the
work. A lane's rows wait in its list state, those of a batch as one element of compressed columns, until the watermark has passed them, when no earlier one can come any more; an event-time
timer wakes the lane then, and ``take`` gets each key's in the order of time and position, with what the key holds. ``take`` may name a
time at which the key is woken, for what is due when nothing more comes. There is one timer a batch, for the lane's earliest row, and behind
each call one for what comes next: as many calls as batches, however many rows come. State is what came within the
watermark's delay, and what the keys hold; a task has one lane's waiting rows in memory.

The state store is RocksDB, which such processors need; ``use_rocksdb`` sets it for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegralType


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


LANES = 256
#: The column that says in bits which whole numbers of a row are null: in pandas one null would make floats of all of a batch's.
ABSENT = "absent"


def _block(rows: pa.Table) -> tuple[int, int, bytes]:
    """Rows as one element of a list state: first and last time, and the rows in compressed columns."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    return pc.min(rows["us"]).as_py(), pc.max(rows["us"]).as_py(), sink.getvalue().to_pybytes()


class InOrder(StatefulProcessor):
    """Rows of key, us (event time in microseconds), pos and ``fields``; ``held`` is the schema of what a key holds, ``result`` of what comes out."""

    fields, held, result = "", "", ""

    def take(self, key: str | None, held: tuple | None, ready: list[tuple], now: int) -> tuple[list[tuple], tuple, int | None]:
        """Rows out of the rows ``ready`` (us, pos, fields) up to the watermark ``now``, what the key holds then, and when to wake it at the
        latest (microseconds)."""
        raise NotImplementedError

    def names(self) -> list[str]:
        return ["us", "pos", "key", *(f.split()[0] for f in self.fields.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, last long, rows binary")
        self.dues = handle.getListState("dues", "us long, key string")
        self.state = handle.getMapState("held", "key string", self.held)
        self.columns = self.names()
        self.done: dict[int, int] = {}  # the watermark up to which a lane is finished: spares calls

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        self.done.pop(key[0], None)
        blocks = []
        for b in rows:
            if len(b):
                gone = [b[ABSENT].to_numpy() >> i & 1 > 0 if ABSENT in b else None for i in range(len(self.columns))]
                gone = [g if g is not None and g.any() else None for g in gone]
                blocks.append(_block(pa.table({c: pa.array(b[c], mask=g, from_pandas=True) for c, g in zip(self.columns, gone, strict=True)})))
        if blocks:
            self.waiting.appendList(blocks)
            self.handle.registerTimer(-(-min(first for first, *_ in blocks) // 1000))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.done.get(key[0]) == now:
            return
        self.done[key[0]] = now
        dues = {k: us for us, k in self.dues.get()}
        ready: dict[str | None, list[tuple]] = {k: [] for k, us in dues.items() if us <= now}
        rest, changed = [], False
        for first, last, data in self.waiting.get():
            if first > now:
                rest.append((first, last, bytes(data)))
                continue
            changed, rows = True, pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()
            if last > now:
                rest.append(_block(rows.filter(pc.greater(rows["us"], now))))
                rows = rows.filter(pc.less_equal(rows["us"], now))
            for us, pos, k, *more in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                ready.setdefault(k, []).append((us, pos, *more))
        out, before = [], dict(dues)
        for k, rows in ready.items():
            name = ("" if k is None else f"={k}",)
            held = tuple(self.state.getValue(name)) if self.state.containsKey(name) else None
            found, held, due = self.take(k, held, sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1])), now)
            out += found
            self.state.updateValue(name, held)
            dues.pop(k, None)
            if due is not None:
                dues[k] = max(due, now + 1)
        if dues != before:
            self.dues.put([(us, k) for k, us in dues.items()]) if dues else self.dues.clear()
        if changed:
            self.waiting.put(rest) if rest else self.waiting.clear()
        coming = [r[0] for r in rest] + list(dues.values())
        if coming:
            self.handle.registerTimer(max(-(-min(coming) // 1000), now // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.result.split(", ")], dtype=object)  # whole numbers beside None stay whole

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, processor: InOrder, lanes: int = LANES) -> DataFrame:
    """``rows`` (key string, us, pos, fields), with a watermark, through ``processor``. A row without a time has no place in the order and is left out."""
    whole = [(i, c) for i, c in enumerate(processor.names()) if isinstance(rows.schema[c].dataType, IntegralType)]
    absent = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in whole), F.lit(0))
    rows = rows.where("us is not null").withColumn(ABSENT, absent.cast("long")).withColumns({c: F.coalesce(c, F.lit(0)) for _, c in whole})
    laned = rows.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(lanes)))
    return laned.groupBy("lane").transformWithStateInPandas(processor, processor.result, "Append", "EventTime")
