"""Operator 2, language identification by cross-parsing entropy.

Per language a suffix automaton is built from a bounded sample of labelled text. A text is parsed against
each automaton into longest matches: one phrase ends where the automaton has no transition, the next starts
there. The estimate of cross entropy is ``phrases * log2(sample length) / text length``; the language with
the least wins. ``score`` is 1 - best / second best, from 0 (undecided) to 1.

Scale: the sample is bounded (``TRAIN_DOCS`` whole documents a language, of ``TRAIN_CHARS`` characters at most where there are such, chosen by the
least hash in each of ``TRAIN_DOCS`` buckets, a plain partial aggregate). The automata are built from it once, as
sparse edges (three a sampled letter at most, whatever the alphabet; most states have one), and are what is sent to the tasks; they grow
with the number of languages only. Prediction is one narrow pass without shuffle. Workers step all texts of a batch
through an automaton in lock-step as arrays. Long texts are cut into lanes of ``LANE`` letters for that; where a
phrase runs over a cut, the lane behind is parsed again from the phrase's state up to the place where both parses
start a phrase, so the phrases are those of the whole text. Memory is bounded by ``BATCH_CHARS`` and one text.

Defined cases: null text and texts without a letter give ``und`` with score 0; with no labelled text every text
is ``und``; one single learned language gives score 1 to each text; ties go to the language first in order;
repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The bounded sample: documents per language, whole ones, of up to so many characters as long as a language has such.
TRAIN_DOCS, TRAIN_CHARS = 48, 1536
LANE, BATCH_CHARS = 1024, 1_000_000
SPACE, OTHER, BREAK = 1, 2, 3  # codes of a gap between words, of letters that no sample has, and between sampled texts
ROOT = 1  # state 0 is "no transition"


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text): at most TRAIN_DOCS whole texts a language; texts of more than TRAIN_CHARS characters only where a bucket has no other."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.where("lang is not null and text is not null").where(~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))).where(F.col("text").rlike(r"\p{L}"))
    d = d.withColumn("h", F.xxhash64("doc_id", "text"))
    least = d.groupBy("lang", F.pmod("h", F.lit(TRAIN_DOCS)).alias("b")).agg(F.min(F.struct(F.greatest(F.char_length("text"), F.lit(TRAIN_CHARS)).alias("size"), "h")).alias("m")).select("lang", "m.h")
    # TRAIN_DOCS rows a language: a sample of fixed size
    rows = d.join(F.broadcast(least), ["lang", "h"]).select("lang", "h", "text")
    rows = rows.dropDuplicates(["lang", "h"]).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, by state; state 0 is none, ROOT the start."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], ROOT
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(ROOT)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


#: Bytes of the table of states with several edges; beyond it these edges stand in an open-addressed table.
DENSE_BYTES = 64_000_000


class Edges:
    """Transitions of all languages' automata, by (state, code); state 0, and no state's next one, is "none".

    States are numbered anew, those with several edges first. These have a row of a table; of the others, which are
    most, the code and the next state of the one edge are kept. For large alphabets the rows are kept sparse.
    """

    def __init__(self, automata: list[list[dict[int, int]]], alphabet: int):
        self.alphabet = alphabet
        several = [(a, s) for a, automaton in enumerate(automata) for s, e in enumerate(automaton) if s == ROOT or len(e) > 1]
        single = [(a, s) for a, automaton in enumerate(automata) for s, e in enumerate(automaton) if s > ROOT and len(e) <= 1]
        number = {x: i + 1 for i, x in enumerate(several + single)}
        self.wide = len(several) + 1
        self.start = np.array([number[a, ROOT] for a in range(len(automata))], np.int32)
        self.code, self.next = np.full(len(single), -1, np.int32), np.zeros(len(single), np.int32)
        for i, (a, s) in enumerate(single):
            for c, t in automata[a][s].items():
                self.code[i], self.next[i] = c, number[a, t]
        keys = np.array([number[a, s] * alphabet + c for a, s in several for c in automata[a][s]], np.int64)
        values = np.array([number[a, t] for a, s in several for t in automata[a][s].values()], np.int32)
        self.dense = None
        if self.wide * alphabet * 4 <= DENSE_BYTES:
            self.dense = np.zeros(self.wide * alphabet, np.int32)
            self.dense[keys] = values
        else:
            self._sparse(keys, values)
        root = np.repeat(self.start, alphabet)
        #: The state after one letter, by language and code.
        self.root = np.maximum(self.step(root, np.tile(np.arange(alphabet, dtype=np.int32), len(self.start))), 0)
        self.root = np.where(self.root > 0, self.root, root)

    def _sparse(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.key[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.key[at[placed]], self.value[at[placed]] = keys[placed], values[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            keys, values, at = keys[left], values[left], at[left] + 1 & self.last

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        out, look, at = np.zeros(len(keys), np.int32), np.arange(len(keys)), self._home(keys)
        while len(look):
            got = self.key[at]
            hit = got == keys
            out[look[hit]] = self.value[at[hit]]
            on = ~hit & (got >= 0)
            look, keys, at = look[on], keys[on], at[on] + 1 & self.last
        return out

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            out = self.dense[np.where(state < self.wide, state, 0) * self.alphabet + code]
        else:
            out = np.zeros(len(state), np.int32)
            at = np.flatnonzero(state < self.wide)
            out[at] = self._found(state[at].astype(np.int64) * self.alphabet + code[at])
        at = np.flatnonzero(state >= self.wide)
        one = state[at] - self.wide
        out[at] = np.where(self.code[one] == code[at], self.next[one], 0)
        return out


class CrossParser:
    """Automata of all languages and the array parser. Built once from the sample."""

    def __init__(self, sample: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in sample})
        self.letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.code = np.where(self.letter, OTHER, SPACE).astype(np.int32)
        for i, ch in enumerate(sorted({ch for _, t in sample for ch in t.lower() if ch.isalpha()})):
            self.code[ord(ch)] = BREAK + 1 + i
        automata, self.bits = [], []
        for lang in self.langs:
            codes, size = self.encode([t for x, t in sample if x == lang])
            joined = np.insert(codes, np.cumsum(size)[:-1], BREAK)
            automata.append(suffix_automaton(joined.tolist()))
            self.bits.append(np.log2(max(2, len(codes))))
        self.edges = Edges(automata, int(self.code.max()) + 1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, one gap for each run without letters, none in front; and each text's count."""
        low = [t.lower() for t in texts]
        cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, low), np.int64, len(low))
        letter = self.letter[cp]
        after = np.zeros(len(cp), bool)
        after[1:] = letter[:-1]
        begin = np.cumsum(size) - size
        after[begin[size > 0]] = False
        keep = letter | after
        kept = np.concatenate(([0], np.cumsum(keep)))
        return self.code[cp[keep]], kept[begin + size] - kept[begin]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [text, language] and letters with gaps [text]."""
        codes, size = self.encode(texts)
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(size)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = (np.cumsum(size) - size)[owner] + nth * LANE
        long = np.minimum(LANE, size[owner] - nth * LANE)
        total = [np.bincount(owner, n, len(size)) for n in self._lanes(codes, start, long, nth > 0)]
        return (np.stack(total, 1) if total else np.zeros((len(size), 0))), size

    def _lanes(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """Phrases that start in each lane [language, lane]. Lanes that go on a text stand behind the one they follow.

        All languages are stepped together: entry ``language * lanes + lane``.
        """
        edges, langs, n = self.edges, len(self.langs), len(size)
        lang = np.repeat(np.arange(langs), n)
        start, long = np.tile(begin, langs), np.tile(size, langs)
        flag = lang * len(codes) + start  # where an entry's marks begin
        first = edges.start[lang]
        row = lang * edges.alphabet
        begins = np.zeros(langs * len(codes), bool)  # phrases of the lanes on their own
        order = np.argsort(-long, kind="stable")
        active = langs * n - np.searchsorted(long[order][::-1], np.arange(LANE), side="right")
        at, mark, none, table_row = start[order], flag[order], first[order], row[order]
        state = none.copy()
        for t in range(int(long.max()) if len(long) else 0):
            k = int(active[t])
            c = codes[at[:k] + t]
            s = edges.step(state[:k], c)
            new = np.flatnonzero((s == 0) | (state[:k] == none[:k]))
            begins[mark[new] + t] = True
            s[new] = edges.root[table_row[new] + c[new]]
            state[:k] = s
        end = np.empty(langs * n, np.int32)
        end[order] = state
        own_end = end.copy()
        upto = np.concatenate(([0], np.cumsum(begins, dtype=np.int32)))
        count = upto[flag + long] - upto[flag]
        entered = first.copy()
        follows = np.flatnonzero(np.tile(goes_on, langs))
        while True:  # lanes that a phrase runs into
            lane = follows[end[follows - 1] != entered[follows]]
            if not len(lane):
                return count.reshape(langs, n)
            entered[lane] = state = end[lane - 1]
            started, t = np.zeros(len(lane), np.int64), 0
            while len(lane):
                c = codes[start[lane] + t]
                s = edges.step(state, c)
                new = (s == 0) | (state == first[lane])
                met = new & begins[flag[lane] + t]
                here = lane[met]
                count[here], end[here] = started[met] + upto[flag[here] + long[here]] - upto[flag[here] + t], own_end[here]
                started, state = started + new, np.where(new, edges.root[row[lane] + c], s)
                t += 1
                over = ~met & (long[lane] == t)  # the phrase, or others than the lane's own, go on to the next lane
                count[lane[over]], end[lane[over]] = started[over], state[over]
                stay = ~met & ~over
                lane, started, state = lane[stay], started[stay], state[stay]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        total, size = self.phrases(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = total * np.array(self.bits)
        best = cost.argmin(1)
        low = np.sort(cost, 1)
        score = 1 - low[:, 0] / np.maximum(low[:, 1], 1e-9) if len(self.langs) > 1 else np.ones(len(texts))
        none = size == 0
        return ["und" if e else self.langs[b] for e, b in zip(none, best, strict=True)], np.where(none, 0.0, np.clip(score, 0, 1))


def by_size(texts: list[str], limit: int) -> Iterator[slice]:
    """Slices of at most ``limit`` characters (one text at least)."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(a, i)
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield slice(a, len(texts))


def identify_language(docs: DataFrame, sample: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(CrossParser(training_sample(docs) if sample is None else sample))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = sent.value
        for b in batches:
            texts = b["text"].tolist()
            langs, scores = [], []
            for part in by_size(texts, BATCH_CHARS):
                p, s = parser.predict(texts[part])
                langs += p
                scores.append(s)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": langs, "score": np.concatenate(scores) if scores else []})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def of_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that get a language (not ``und``), with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(CrossParser(training_sample(docs)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = sent.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for part in by_size(texts, BATCH_CHARS):
                langs, _ = parser.predict(texts[part])
                yield b.slice(part.start, part.stop - part.start).filter(pa.array([x != "und" for x in langs]))

    return docs.mapInArrow(keep, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
