"""The semantic cache as state: per scope (a document) the answers to at most ``most`` questions.

Requests are looked up and stored in their order. One is a hit if a live entry is at least ``threshold`` similar, the most similar first
and of equals the oldest; else its own answer becomes an entry. Entries live for ``life`` seconds; beyond ``most`` the oldest goes; a request
that says that the scope was ingested again clears it. ``replayed`` runs a log as a batch, ``answered`` a stream, with state
and timers that clear entries of a scope which nothing asks any more. Both hold one scope's entries. What a request
finds depends on all before it, so a scope's requests are one sequence: they stream through one task.

Where many requests share vectors, ``referring`` stores those once: requests and entries carry a number, and a worker reads
the vectors, whose size is checked, from the shared folder. More of them are carried by the requests themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ordered import InOrder, in_order

MOST, THRESHOLD, LIFE = 200, 0.92, 86_400.0
#: Bytes of single-precision vectors that a worker holds.
HELD = 1 << 28
RESULT = "key string, request_id long, entry_id long, similarity double"


def unit(vector: list[float] | np.ndarray) -> tuple[np.ndarray, float]:
    """A vector of length one (or zero), and the length it had."""
    v = np.asarray(vector, np.float64)
    size = np.linalg.norm(v)
    return (v / size if size else v), size


class Entries:
    """One scope's entries, from the oldest: number, request, time in microseconds, unit vector, the vector's number if it has one."""

    def __init__(self, most: int, threshold: float, life: float):
        self.most, self.threshold, self.life, self.rows, self.number = most, threshold, int(life * 1e6), [], 0

    def expire(self, us: int) -> list[int]:
        """Drop what has lived its time; the numbers of the dropped."""
        gone = [r[0] for r in self.rows if r[2] <= us - self.life]
        self.rows = [r for r in self.rows if r[2] > us - self.life]
        return gone

    def ask(self, request: int, us: int, vector: list[float] | None, ref: int | None = None) -> tuple[int | None, float | None]:
        """The entry that answers a request and its similarity; without one the request's own answer is stored."""
        self.expire(us)
        if vector is None:
            return None, None
        v, size = unit(vector)
        if self.rows:
            near = (np.stack([r[3] for r in self.rows]) @ v).round(9)
            best = int(near.argmax())
            if size and near[best] >= self.threshold:
                return self.rows[best][1], float(near[best])
        self.rows.append((self.number, request, us, v, ref))
        self.number += 1
        self.rows = self.rows[-self.most :]
        return None, None


class SemanticCache(InOrder):
    """Requests (key, us, pos: request_id, clears, embedding) to RESULT."""

    fields, result = "clears boolean, embedding array<double>", RESULT
    held = "next long, entries array<struct<number: long, request_id: long, us: long, unit: array<double>>>"

    def __init__(self, most: int, threshold: float, life: float):
        self.settings = (most, threshold, life)

    def asked(self, vector):
        """The vector of a request, and its number if it has one."""
        return vector, None

    def restored(self, vector):
        """Unit vector and number of a held entry."""
        return np.asarray(vector), None

    def take(self, key: str | None, held: tuple | None, ready: list[tuple], now: int) -> tuple[list[tuple], tuple, int | None]:
        cache, out = Entries(*self.settings), []
        if held:
            cache.number, cache.rows = held[0], [(n, r, us, *self.restored(v)) for n, r, us, v in held[1]]
        for us, request, clears, vector in ready:
            if clears:
                cache.rows = []
            entry, near = (None, None) if clears else cache.ask(request, us, *self.asked(vector))
            out.append((key, request, entry, near))
        cache.expire(now)
        kept = [(n, r, us, v.tolist() if ref is None else ref) for n, r, us, v, ref in cache.rows]
        return out, (cache.number, kept), cache.rows[0][2] + cache.life if cache.rows else None


_READ: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}  # of one folder: numbers in order, places, values, nulls


def _vectors(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if path not in _READ:
        from pyarrow import fs

        _READ.clear()
        system, folder = fs.FileSystem.from_uri(path)
        t = pq.read_table(folder, filesystem=system, columns=["ref", "embedding"]).sort_by("ref").combine_chunks()
        v = pa.concat_arrays(t["embedding"].chunks) if t.num_rows else pa.array([], pa.list_(pa.float32()))
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        _READ[path] = t["ref"].to_numpy(), ends, v.flatten().to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False)
    return _READ[path]


class ReferringCache(SemanticCache):
    """The same for requests whose vectors stand in the folder ``path`` under numbers (``ref``)."""

    fields, held = "clears boolean, ref long", "next long, entries array<struct<number: long, request_id: long, us: long, ref: long>>"

    def __init__(self, most: int, threshold: float, life: float, path: str):
        super().__init__(most, threshold, life)
        self.path = path

    def asked(self, vector):
        refs, ends, values, null = _vectors(self.path)
        at = None if vector is None else int(np.searchsorted(refs, vector))
        return (None if at is None or null[at] else values[ends[at] : ends[at + 1]]), vector

    def restored(self, vector):
        return unit(self.asked(vector)[0])[0], vector


def referring(vectors: DataFrame) -> tuple[DataFrame, str] | None:
    """``vectors`` (id, embedding) as stored rows of id and ref, and the folder of the vectors; None if they are more than a worker holds."""
    size = vectors.agg(F.sum(F.size("embedding").cast("long") * 4)).first()[0]
    if (size or 0) > HELD:
        return None
    kept = stored(vectors.withColumns({"ref": F.monotonically_increasing_id(), "embedding": F.col("embedding").cast("array<float>")}), "vectors")
    files = kept.inputFiles()
    return (kept.drop("embedding"), files[0].rpartition("/")[0]) if files else None


def answered(requests: DataFrame, most: int = MOST, threshold: float = THRESHOLD, life: float = LIFE, late: str = "10 minutes", vectors: str | None = None) -> DataFrame:
    """RESULT of a stream of ``requests`` (key, at timestamp, request_id, clears, embedding): which entry answers each, null for none.

    With ``vectors``, the folder of ``referring``, requests have ref instead of embedding.
    """
    vector = F.col("embedding").cast("array<double>").alias("embedding") if vectors is None else F.col("ref")
    rows = requests.withWatermark("at", late).select("key", "at", F.unix_micros("at").alias("us"), F.col("request_id").alias("pos"), "clears", vector)
    return in_order(rows, SemanticCache(most, threshold, life) if vectors is None else ReferringCache(most, threshold, life, vectors))


def replayed(requests: DataFrame, most: int = MOST, threshold: float = THRESHOLD, life: float = LIFE) -> DataFrame:
    """The same of a log: rows sorted by scope and time stream through."""
    rows = requests.select("key", F.unix_micros("at").alias("us"), "request_id", "clears", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for b in batches:
            out = []
            for key, us, request, clears, vector in b.itertuples(index=False):
                if held is None or key != now:
                    now, held = key, Entries(most, threshold, life)
                if clears:
                    held.rows = []
                entry, near = (None, None) if clears else held.ask(request, us, vector)
                out.append((key, request, entry, near))
            yield pd.DataFrame(out, columns=["key", "request_id", "entry_id", "similarity"]).astype({"entry_id": "Int64"})

    return rows.repartition("key").sortWithinPartitions("key", "us", "request_id").mapInPandas(run, RESULT)
