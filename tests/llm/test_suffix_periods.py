"""Texts whose period is about as long as a window has grams."""

import random

from quarryspark.llm.suffix_dedup import cut_out, runs


def test_op8_periods_about_the_window(spark):
    r = random.Random(53)
    texts = []
    for period in range(50, 57):
        for total in range(150, 171):
            line = "".join(r.choice("abcdefgh") for _ in range(period - 1)) + "\n"
            texts.append((line * 4)[:total])
    got = {x["doc_id"]: x["n_removed"] for x in cut_out(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i, t in enumerate(texts):
        seen, cover = set(), bytearray(len(t))
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(t[p : p + 100])
        assert got[i] == sum(cover), (i, len(t))


def test_op8_three_lines_of_53_bytes_repeat_within():
    r = random.Random(5)
    line = bytes(r.randrange(97, 123) for _ in range(53))
    assert runs([line * 3])[5].any()
