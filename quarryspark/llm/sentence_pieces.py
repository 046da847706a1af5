"""Operator 7, SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text gets one blank in front, blanks become the marker, and the segmentation of greatest total log score is
found; characters without a piece become the pieces of their UTF-8 bytes. Decoding joins the bytes of all
pieces, turns markers into blanks and drops the first, which gives the text back exactly: a marker character
that stands in the text itself is encoded by its bytes.

No piece holds a marker behind another character, or a line break (others are refused), so the best segmentation of a text is that
of its stretches (blanks and the word behind them). Stretches recur; each worker keeps the ids of those it has
seen, up to ``CACHE`` of them. New ones go through the trie in lock-step as arrays, grouped by length. The pass
is narrow: no shuffle, whole texts, memory bounded by the batch and the cache.

A vocabulary made by pair merging holds merge ranks instead of log scores; then the log score of rank r is
that of Zipf's law, ``-log(r + 2)``.

Defined cases: null and empty texts have no ids and decode to the empty text; texts of any length are whole;
repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language_id import by_size

MARKER = "▁"
CACHE, BATCH_CHARS, LANES = 200_000, 1_000_000, 20_000
UNKNOWN_BELOW = 10.0  # an unknown character scores this much below the worst piece
_STRETCH = re.compile(r" +[^ \n]*|[^ \n]+|\n")


def load_pieces(path: str) -> tuple[dict[str, int], dict[str, float], list[int], list[bytes]]:
    """Ids of pieces, their log scores, ids of the 256 bytes, and the bytes that each id decodes to."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, rank, byte_ids, out = {}, {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            out.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            out.append(b"")
        else:
            if MARKER in piece.lstrip(MARKER) or "\n" in piece:
                raise ValueError(f"piece {piece!r}: pieces with a marker behind another character or a line break aren't supported")
            ids[piece], rank[piece] = i, model.get_score(i)
            out.append(piece.replace(MARKER, " ").encode())
    if min(rank.values()) < -1000:  # merge ranks: 0, -1, -2, ...; characters that no merge makes come last
        last = -min(x for x in rank.values() if x > -1e8) + 1
        rank = {p: -float(np.log(min(-x, last) + 2)) for p, x in rank.items()}
    return ids, rank, byte_ids, out


class DoubleArray:
    """A trie over code points as two arrays: the child of node s by code c is base[s] + c if check there is s."""

    def __init__(self, words: dict[str, int]):
        common = [ch for ch, _ in Counter("".join(words)).most_common()]  # small codes for frequent characters
        self.codes = {ch: i + 1 for i, ch in enumerate(common)}
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, v in words.items():
            s = 0
            for ch in word:
                c = self.codes[ch]
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    value.append(-1)
                s = children[s][c]
            value[s] = v
        size = len(children) * 2 + len(self.codes) * 4 + 16
        used, base, check, out = np.zeros(size, bool), np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        low = len(self.codes) + 1  # slots from here on suit any first child
        used[:low] = True
        free, window, queue = low, 4096, [(0, 0)]
        for node, slot in queue:
            kids = np.array(sorted(children[node]), np.int64)
            if not len(kids):
                continue
            while used[free]:
                free += 1
            at = free
            while len(kids) > 1:  # the first window of slots in which all children find room
                if at + window + low >= len(used):
                    used = np.append(used, np.zeros(size, bool))
                    base, check, out = np.append(base, np.zeros(size, np.int64)), np.append(check, np.full(size, -1)), np.append(out, np.full(size, -1))
                bases = at + np.flatnonzero(~used[at : at + window]) - kids[0]
                for c in kids[1:]:
                    bases = bases[~used[bases + c]]
                if len(bases):
                    at = int(bases[0] + kids[0])
                    break
                at += window
            b = at - int(kids[0])
            base[slot] = b
            used[b + kids], check[b + kids] = True, slot
            for c in kids.tolist():
                out[b + c] = value[children[node][c]]
                queue.append((children[node][c], b + c))
        pad = max(self.codes.values()) + 1
        self.base = base.astype(np.int32)
        self.check = np.append(check, np.full(pad, -1)).astype(np.int32)
        self.value = np.append(out, np.full(pad, -1)).astype(np.int32)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class PieceCoder:
    def __init__(self, path: str):
        self.ids, self.scores, self.byte_ids, self.out = load_pieces(path)
        self.longest = max(map(len, self.ids))
        self.trie = DoubleArray(self.ids)
        self.score = np.full(len(self.out), -np.inf)
        for p, i in self.ids.items():
            self.score[i] = self.scores[p]
        self.unknown = min(self.scores.values()) - UNKNOWN_BELOW
        self.code = np.zeros(0x110000, np.int32)
        for ch, c in self.trie.codes.items():
            self.code[ord(ch)] = c
        self.code[ord(" ")], self.code[ord(MARKER)] = self.code[ord(MARKER)], 0
        self._start_anew()

    def _start_anew(self) -> None:
        self.number, self.first, self.size, self.flat = _Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none empty, equal handling of any lengths) one after another, and their counts."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        n, most = len(words), int(length.max())
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        begin = (np.cumsum(length) - length)[order]
        length = length[order]
        # position-major arrays over all characters: lane k's position i is at place[i] + k, lanes of length > i come first
        active = n - np.searchsorted(length[::-1], np.arange(most + self.longest + 2), side="right")  # lanes longer than i
        row = np.concatenate(([0], np.cumsum(np.concatenate(([n], active[:most])))))  # rows of best: position 0 has n lanes, i has active[i-1]
        best = np.full(row[-1], -np.inf)
        best[:n] = 0.0
        back_id, back_from = np.zeros(row[-1], np.int64), np.zeros(row[-1], np.int64)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(most):
            k = int(active[i])
            lane, node = np.arange(k), np.zeros(k, np.int64)
            here = best[row[i] : row[i] + k]
            single = np.zeros(k, bool)
            for d in range(self.longest):
                if d:
                    keep = lane < active[i + d]
                    lane, node = lane[keep], node[keep]
                if not len(lane):
                    break
                nxt = base[node] + self.code[cp[begin[lane] + i + d]]
                ok = check[nxt] == node
                if d == 0 and i >= 0:
                    ok &= self.code[cp[begin[lane] + i]] > 0
                lane, node = lane[ok], nxt[ok].astype(np.int64)
                v = value[node]
                hit = np.flatnonzero(v >= 0)
                if len(hit):
                    at, piece = lane[hit], v[hit]
                    if d == 0:
                        single[at] = True
                    got = here[at] + self.score[piece]
                    to = row[i + d + 1] + at
                    more = got > best[to]
                    best[to[more]], back_id[to[more]], back_from[to[more]] = got[more], piece[more], i
            none = np.flatnonzero(~single)
            if len(none):
                got, to = here[none] + self.unknown, row[i + 1] + none
                more = got > best[to]
                to, none = to[more], none[more]
                best[to], back_id[to], back_from[to] = got[more], -1 - cp[begin[none] + i].astype(np.int64), i
        lanes, found, pos = np.arange(n), [], length.copy()
        while len(lanes):
            at = row[pos] + lanes
            found.append((lanes, back_id[at]))
            pos = back_from[at]
            lanes, pos = lanes[pos > 0], pos[pos > 0]
        lane, ids = np.concatenate([x for x, _ in found])[::-1], np.concatenate([x for _, x in found])[::-1]
        lane = order[lane]
        by = np.argsort(lane, kind="stable")
        lane, ids = lane[by], ids[by]
        if (ids < 0).any():  # characters without a piece: their bytes
            each = [[i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] for i in ids.tolist()]
            lane, ids = np.repeat(lane, [len(e) for e in each]), np.array(list(itertools.chain.from_iterable(each)))
        return ids.astype(np.int32), np.bincount(lane, minlength=n)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.number) > CACHE:
            self._start_anew()
        words = [_STRETCH.findall(" " + t) if t else [] for t in texts]
        count = np.fromiter(map(len, words), np.int64, len(words))
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(count.sum()))
        new = list(itertools.islice(reversed(self.number), len(self.number) - known))[::-1]
        if new:
            parts = [self.viterbi(new[a : a + LANES]) for a in range(0, len(new), LANES)]
            size = np.concatenate([n for _, n in parts])
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, *[i for i, _ in parts]])
        size = self.size[at]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[at] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        bound = np.concatenate(([0], end))[np.cumsum(count)]
        return np.split(ids, bound[:-1])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_coders: dict[str, PieceCoder] = {}


def _coder(path: str) -> PieceCoder:
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), text: one row per row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(path)
        for b in batches:
            texts = b["text"].tolist()
            for s in by_size(texts, BATCH_CHARS):
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[s], "ids": coder.encode(texts[s])})

    return _texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_pieces(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [coder.decode(np.asarray(i)) for i in b["ids"]]})

    return rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInPandas(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, round_trip: encoded and decoded in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(path)
        for b in batches:
            texts = b["text"].tolist()
            for s in by_size(texts, BATCH_CHARS):
                ids = coder.encode(texts[s])
                back = [coder.decode(i) for i in ids]
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[s],
                    "n_ids": [len(i) for i in ids],
                    "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
                    "round_trip": [x == t for x, t in zip(back, texts[s], strict=True)],
                })

    return _texts(docs).mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
