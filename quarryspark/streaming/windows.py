"""Greedy duration windows over an unordered stream, by a stateful processor with timers.

Segments may come in any order within the watermark's delay, see ``ordered``. In order they enter their source's open window. A window
closes when a segment would make it last ``limit``, or by a timer once the watermark is so far that any later segment
would: a source that falls silent needs no end mark. State is what came within the delay and one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import InOrder, in_order

WINDOWS = "key string, chunk_index int, text string, timestamp_start long, timestamp_end long"


class DurationWindows(InOrder):
    """Segments (key, us, pos, duration in seconds, text) to WINDOWS."""

    fields, result = "duration double, text string", WINDOWS
    held = "n int, texts array<string>, start double, end double"

    def __init__(self, limit: float):
        self.limit = limit

    def take(self, key: str | None, held: tuple | None, ready: list[tuple], now: int) -> tuple[list[tuple], tuple, int | None]:
        n, texts, start, end = held or (0, [], 0.0, 0.0)
        texts, out = list(texts), []
        for us, _, duration, text in ready:
            stop = us / 1e6 + (duration or 0.0)
            if texts and stop - start >= self.limit:
                out.append((key, n, " ".join(texts), round(start), round(end)))
                n, texts = n + 1, []
            if not texts:
                start = us / 1e6
            texts.append(text or "")
            end = stop
        if texts and now / 1e6 - start >= self.limit:  # any later segment would close it
            out.append((key, n, " ".join(texts), round(start), round(end)))
            n, texts = n + 1, []
        return out, (n, texts, start, end), int((start + self.limit) * 1e6) + 1 if texts else None


def unordered_windows(segments: DataFrame, limit: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """WINDOWS of a stream of ``segments`` (key string, at timestamp, pos, duration, text). Segments later than ``late`` are left out."""
    rows = segments.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    return in_order(rows, DurationWindows(limit))
