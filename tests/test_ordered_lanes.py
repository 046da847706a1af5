"""Rows of many keys in one lane: few timers and calls, and what each key would give by itself."""

import random

import pandas as pd

from quarryspark.streaming import cache, windows


class _List:
    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def appendList(self, rows):
        self.calls.append("append")
        self.rows += rows

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def get(self):
        return iter(list(self.rows))

    def clear(self):
        self.rows = []


class _Map(dict):
    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v


class _Lane:
    """A state store and a watermark for one lane."""

    def __init__(self, processor):
        self.processor, self.timers, self.calls, self.ms = processor, set(), [], 0
        processor.init(self)

    def getListState(self, *_):
        return _List(self.calls)

    def getMapState(self, *_):
        return _Map()

    def registerTimer(self, ms):
        self.calls.append("timer")
        self.timers.add(ms)

    def getCurrentWatermarkInMs(self):
        return self.ms

    def batch(self, rows, ms):
        """Rows come, then the watermark moves."""
        list(self.processor.handleInputRows((0,), iter([rows]), self))
        return self.moved(ms)

    def moved(self, ms):
        self.ms, out = ms, []
        while due := sorted(t for t in self.timers if t <= ms):
            for t in due:
                for b in self.processor.handleExpiredTimer((0,), self, None):
                    out += list(b.itertuples(index=False, name=None))
                self.timers.discard(t)
        return out


def test_one_timer_a_batch():
    lane = _Lane(windows.DurationWindows(60.0))
    rows = pd.DataFrame({"key": [f"k{n % 50}" for n in range(1000)], "us": [n * 1_000_000 for n in range(1000)], "pos": range(1000), "duration": [0.0] * 1000, "text": [f"w{n}" for n in range(1000)]})
    out = lane.batch(rows.iloc[:500], 300_000) + lane.batch(rows.iloc[500:], 700_000)
    assert lane.calls.count("timer") <= 6
    out += lane.moved(10_000_000)
    assert not lane.timers and len(lane.processor.waiting.rows) == 0
    words = sorted(w for r in out for w in r[2].split())
    assert words == sorted(f"w{n}" for n in range(1000))
    assert sorted(r[1] for r in out if r[0] == "k7") == list(range(10))  # every 50 s one, two a window of 60 s


def test_keys_of_a_lane_do_not_meet():
    r, rows = random.Random(1), []
    for n in range(400):
        rows.append((f"k{n % 7}" if n % 9 else None, n * 500_000, n, n % 31 == 0, [r.random(), r.random() - 0.5, r.random() - 0.5]))
    frame = pd.DataFrame(rows, columns=["key", "us", "pos", "clears", "embedding"])

    def result(part):
        lane = _Lane(cache.SemanticCache(5, 0.9, 60.0))
        out = []
        for a in range(0, 400, 100):
            now = part[part.pos.between(a, a + 99)]
            out += lane.batch(now.sample(frac=1, random_state=a), (a + 50) * 500)
        return out + lane.moved(10_000_000)

    alone = [x for k in [*[f"k{n}" for n in range(7)], None] for x in result(frame[frame.key.isna() if k is None else frame.key == k])]
    plain = lambda x: sorted(((a, b, None if pd.isna(c) else int(c)) for a, b, c, _ in x), key=lambda t: t[1])
    assert plain(result(frame)) == plain(alone) and len(alone) == 400
    assert any(c is not None for *_, c in plain(alone))
