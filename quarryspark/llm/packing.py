"""Operator 3, best-fit packing: a configuration linear program over the length histogram.

1. ``tokenized``: one narrow pass turns each text into token ids, ends it with id 0 and cuts documents of more
   than ``CAPACITY`` tokens into pieces. A piece also gets its rank among the pieces of its length in its task.
2. ``plan``: only the histogram of lengths (``CAPACITY`` rows at most, whatever the input) reaches the driver.
   The linear program has a variable per configuration (a multiset of lengths that fills a sequence) and a row per
   length. It is solved by multiplicative weights: prices per length start at length / capacity, a knapsack dynamic
   program over the capacity prices the configurations, those of best price that hold the least covered lengths
   are used, and the prices of the lengths that they cover fall, so that all lengths are covered alike. Prices over
   the best price are a dual solution, which bounds the number of sequences from below. The fractional solution is rounded
   down, and what remains, a mixture of all lengths, is placed by best fit: each piece, the longest first, where
   least room is left.
3. ``place``: ranks become global by one offset per (task, length); a piece finds sequence and offset in the
   plan by its length and rank. No group is gathered anywhere: a length that a third of all pieces share is
   spread over all tasks.

Defined cases: null text counts as empty and is the single id 0; repeated rows are separate documents; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored, table

CAPACITY, END = 2048, 0
CACHE_WORDS = 200_000  # entries of a worker's word cache before it starts anew
#: Most pricings, configurations taken from one, the share of a length that one use covers at most, and how fast prices fall.
STEPS, TAKEN, SHARE, RATE = 240, 48, 0.1, 0.4

_LETTER, _NUMBER, _SPACE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class WordEncoder:
    """Token ids of whole texts, for a tokenizer that drops white space and splits words from marks.

    Words recur, so their ids are kept. Texts within Latin-1 are split here just as the tokenizer splits
    (lower-casing and normalisation don't interact there); of other texts only the stretches between blanks
    are told apart, since no token crosses one. Texts that may hold special tokens go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.start_anew()

    def start_anew(self) -> None:
        self.number, self.first, self.size, self.flat = _Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _words(self, text: str) -> list[str]:
        if "<|" in text:
            return [text]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            out = []
            for w in re.split(r"[ \n\t]+", text):
                try:
                    w.encode("latin-1")
                    out += _WORD.findall(w.lower())
                except UnicodeEncodeError:
                    out.append(w)
            return out
        return _WORD.findall(text.lower())

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        try:
            if "<|" in "".join(words):
                raise UnicodeError
            "".join(words).encode("latin-1")  # each is one word of the tokenizer then
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
            return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        except UnicodeError:
            each = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            return np.array(list(itertools.chain.from_iterable(each)), "<u4"), np.array([len(e) for e in each], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHE_WORDS:
            self.start_anew()
        words = [self._words(t) for t in texts]
        count = np.fromiter(map(len, words), np.int64, len(words))
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(count.sum()))
        new = list(itertools.islice(reversed(self.number), len(self.number) - known))[::-1]
        parts = [self._ids(new[a : a + 200]) for a in range(0, len(new), 200)]
        if parts:
            size = np.concatenate([n for _, n in parts]).astype(np.int64)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, *[i for i, _ in parts]])
        size = self.size[at]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[at] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        bound = np.concatenate(([0], end))[np.cumsum(count)]
        return np.split(ids, bound[:-1]) if len(texts) else []


_encoders: dict[str, WordEncoder] = {}


def tokenized(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, _part, _rank (and ids): one row per piece."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.setdefault(tokenizer_path, None) or WordEncoder(tokenizer_path)
        _encoders[tokenizer_path] = encoder
        part, seen = TaskContext.get().partitionId(), np.zeros(CAPACITY + 1, np.int64)
        for b in batches:
            for a in range(0, len(b), 500):
                rows = []
                for doc_id, ids in zip(b["doc_id"].iloc[a : a + 500], encoder.encode(b["text"].iloc[a : a + 500].tolist()), strict=True):
                    ids = np.append(ids, np.uint32(END))
                    for k, start in enumerate(range(0, len(ids), CAPACITY)):
                        piece = ids[start : start + CAPACITY]
                        n = len(piece)
                        rows.append((doc_id, k, start, n, zlib.crc32(piece.tobytes()), part, seen[n]) + ((piece.astype(np.int64),) if with_ids else ()))
                        seen[n] += 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"] + ["ids"] * with_ids).astype({"doc_id": "Int64"})
        encoder.start_anew()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long" + ", ids array<long>" * with_ids)


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of lengths that add up to each capacity (none: -inf), and the index of an item of it."""
    best, item = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0.0
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = fits[c]
        if k:
            got = value[:k] + best[c - lengths[:k]]
            j = k - 1 - int(got[::-1].argmax())  # of equals the longest: short ones fill gaps later
            best[c], item[c] = got[j], j if got[j] > -np.inf else -1
    return best, item


def solve(lengths: np.ndarray, count: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Full configurations {index of length: times} with fractional uses, by multiplicative weights, and the best dual bound."""
    weight, covered, uses, bound = np.ones(len(lengths)), np.zeros(len(lengths)), {}, 0.0
    for _ in range(STEPS):
        value = lengths / capacity * weight
        best, item = price(lengths, value, capacity)
        if best.max() <= 0:
            break
        bound = max(bound, float(value @ count / best.max()))  # value / best price: no configuration is worth over 1
        for first in np.argsort(covered, kind="stable")[:TAKEN]:
            config, c = {int(first): 1}, capacity - int(lengths[first])
            if best[c] == -np.inf:
                continue
            while c > 0:
                j = int(item[c])
                config[j] = config.get(j, 0) + 1
                c -= int(lengths[j])
            index, times = np.array(list(config)), np.array(list(config.values()))
            if (times > count[index]).any():  # more pieces than there are: dearer from now on
                weight[index[times > count[index]]] *= 0.7
                continue
            step = float((count[index] / times).min()) * SHARE
            key = tuple(sorted(config.items()))
            uses[key] = uses.get(key, 0.0) + step
            gain = times * step / count[index]
            covered[index] += gain
            weight[index] *= np.exp(-RATE * gain)
        if covered.min() >= 1:
            break
    return [(dict(k), x / max(1.0, covered[list(dict(k))].max())) for k, x in uses.items()], bound


def best_fit(pieces: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """([lengths], times) of {length: pieces}: each piece, the longest first, goes where the least room is left that holds it.

    Pieces of a length are placed at once: a sequence that takes one has less room than any other that could, so it takes
    all that fit before the next. Each length splits one group of equal sequences at most, so the plan grows with the lengths.
    """
    by_room: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []  # sorted, those that some sequence has left

    def add(config: list[int], times: int, room: int) -> None:
        if times:
            if room not in by_room:
                bisect.insort(rooms, room)
            by_room.setdefault(room, []).append((config, times))

    for n, k in sorted(pieces.items(), reverse=True):
        done = []
        while k > 0:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                config, times = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, config, times = capacity, [], k
            each = room // n
            full = min(times, k // each)
            rest = k - full * each if full < times else 0
            done += [(config + [n] * each, full, room - each * n), (config + [n] * rest, bool(rest), room - rest * n)]
            if config:
                add(config, times - full - bool(rest), room)
            k -= full * each + rest
        for group in done:
            add(*group)
    return [group for groups in by_room.values() for group in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], int, float]:
    """([lengths], times) per configuration used, the number of sequences, and a number that no packing goes below."""
    left, used, bound = dict(histogram), [], sum(n * k for n, k in histogram.items()) / capacity

    def take(config: list[int], times: int) -> None:
        used.append((config, times))
        for n in config:
            left[n] -= times
            if not left[n]:
                del left[n]

    full = left.get(capacity, 0)
    if full:
        take([capacity], full)
    if left:
        lengths = np.array(sorted(left), np.int64)
        found, least = solve(lengths, np.array([left[int(n)] for n in lengths], float), capacity)
        bound = max(bound, full + least)
        for config, x in sorted(found, key=lambda f: -f[1]):
            times = min([int(x)] + [left.get(int(lengths[i]), 0) // k for i, k in config.items()])
            if times > 0:
                take([int(lengths[i]) for i, k in config.items() for _ in range(k)], times)
    # what rounding down leaves, and lengths that fill no sequence
    used += best_fit(left, capacity)
    return used, sum(k for _, k in used), bound


def slots(used: list[tuple[list[int], int]], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks, first sequences, offsets. Rank r in the i-th stretch goes to sequence seq[i] + r - rank[i]."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    upto: dict[int, int] = {}
    first = 0
    for config, times in used:
        offset = 0
        for n in config:
            found.setdefault(n, []).append((upto.get(n, 0), first, offset))
            upto[n] = upto.get(n, 0) + times
            offset += n
        first += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in found.items()}


def place(pieces: DataFrame) -> DataFrame:
    """``pieces`` (as of ``tokenized``, stored) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("_part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", "length", before.alias("_before"))
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # CAPACITY rows at most
    used, _, _ = plan(histogram)
    sent = spark.sparkContext.broadcast(slots(used))
    fields = [f for f in pieces.schema.fields if not f.name.startswith("_")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    names = [f.name for f in fields] + ["sequence_id", "offset"]

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank, length = (b["_before"] + b["_rank"]).to_numpy(), b["length"].to_numpy()
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(b) else []:
                ranks, first, offset = sent.value[int(length[at[0]])]
                i = np.searchsorted(ranks, rank[at], side="right") - 1
                seq[at], off[at] = first[i] + rank[at] - ranks[i], offset[i]
            yield b.assign(sequence_id=seq, offset=off)[names]

    return pieces.join(offsets, ["_part", "length"]).mapInPandas(look_up, schema)


def pack(docs: DataFrame, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset: one row per piece."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return place(stored(tokenized(docs, tokenizer_path, with_ids), "pieces"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
