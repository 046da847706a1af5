"""Repeated rows, shared and missing ids, long digits and clashing column names."""

import collections
import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryspark.llm import packing, pii, suffix_dedup


def removed_by_hand(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha) per row: documents are different (id, text), null ids first, then by digest."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    docs = sorted({(i, hashlib.sha256(b).digest(), b) for i, b in raw}, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    seen, out = set(), {}
    for i, _, b in docs:
        gone = [False] * len(b)
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            if w in seen:
                gone[a : a + length] = [True] * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, b] = (i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[r] for r in raw), key=str)


def noise(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(string.ascii_letters + "é ") for _ in range(n))


A, B, C = noise(1, 700), noise(2, 700), noise(3, 400)
CASES = {
    "rows that repeat with a cut": [(0, A), (1, A[:300] + C), (1, A[:300] + C)],
    "two texts under one id": [(0, A), (5, A[:300] + C), (5, B), (5, B)],
    "no ids": [(None, A), (None, A[:300] + C), (None, A), (3, C + B), (None, None)],
    "least id": [(-(1 << 63), A), (None, A[100:400] + C), (1, A[:300]), (-(1 << 63), A)],
    "copies under other ids": [(4, A), (4, A), (2, A), (9, A + B), (9, A + B)],
}


@pytest.mark.parametrize("name", CASES)
def test_suffix_dedup_of_repeated_rows(spark, name):
    docs = spark.createDataFrame(CASES[name], "doc_id long, text string").repartition(3)
    got = suffix_dedup.cut_out(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == removed_by_hand(CASES[name])


def test_long_digits_and_signs_do_not_crash():
    zeros = "0" * 5000 + ".1.1.1"
    assert [s[2] for s in pii.base_spans(zeros)] == ["ip"]
    assert pii.base_spans("1" * 5000 + ".1.1.1") == []
    r = random.Random(0)
    texts = ["".join(r.choice(letters) * r.choice((1, 1, 2, 10_000)) for _ in range(6)) for letters in ("0.1", "0@a.", "+0-. ", "(1) -", "a@.b", "-=A1") for _ in range(4)]
    found = pii.find_spans([zeros, *texts], *pii.trained())
    assert len(found) == len(texts) + 1 and all(set(base) <= set(every) for base, every in found)


def test_long_digits_pass_the_pipeline_stage(spark):
    docs = spark.createDataFrame([(1, "at 0" + "0" * 5000 + ".1.1.1 it ends")], "doc_id long, text string")
    assert corpus_pipeline.personal_data(spark, docs, "").first()["text"] == "at [IP] it ends"


#: Names that the library uses for columns of its own.
INNER = ("_p _m _b _bits _hit _gone _gone_mark row id mark gone gone_mark digest keep_id kept group_size text_sha256 component first sets size key "
         "hk _hk _lk _jk _jh _lh a b v n w held_out lang_pred score spans found piece length _part _rank _before").split()  # fmt: skip


def test_stages_leave_columns_of_any_name_alone(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "Twice the same text"), (2, "twice the same text"), (3, base), (4, base + " more"), (5, "an own text of its own"), (6, "12 34")]
    docs = spark.createDataFrame([(*r, "en", *[100 * r[0] + k for k in range(len(INNER))]) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` long" for c in INNER))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", *INNER]
    got = {r["doc_id"]: list(r)[3:] for r in docs.collect()}
    assert got == {i: [100 * i + k for k in range(len(INNER))] for i in (2, 3, 5)}
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, docs, "").collect()} == {2, 3, 5}


def plain_best_fit(pieces, capacity):
    rooms = []
    for n in sorted(pieces, reverse=True):
        fits = [r for r in rooms if r >= n]
        rooms.append((rooms.pop(rooms.index(min(fits))) if fits else capacity) - n)
    return len(rooms)


def test_grouped_best_fit_is_best_fit():
    r = random.Random(1)
    for _ in range(500):
        capacity = r.choice((10, 20, 50))
        pieces = collections.Counter(r.randint(1, capacity) for _ in range(r.randint(0, 60)))
        found = packing.best_fit(pieces, capacity)
        placed = collections.Counter()
        for config, times in found:
            assert sum(config) <= capacity and times > 0
            for n in config:
                placed[n] += times
        assert placed == pieces and sum(k for _, k in found) == plain_best_fit(list(pieces.elements()), capacity)


def test_plan_grows_with_lengths_not_with_pieces():
    for h in ({1500: 10**7}, {n: 10_000 for n in range(1025, 2040)}):
        used, n, bound = packing.plan(h)
        assert len(used) < 10_000 and n == sum(h.values()) >= bound


def test_grouped_plan_places_every_piece(spark):
    rows = [(i, "w " * (1499 if i % 3 else 700)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("k"), F.count("*").alias("m")).collect()
    assert all(r["n"] <= 2048 and r["k"] == r["m"] for r in got) and len(got) == 50
