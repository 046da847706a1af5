"""Facts sought by their rarest grams against a search of all pairs."""

import random

import pytest

from quarryspark.operators import evaluation, grams


def by_hand(texts, facts, fold):
    f = (lambda x: x.lower()) if fold else (lambda x: x)
    return sorted(((i, t) for t, x in texts if x is not None for i, y in facts if y and f(y) in f(x)), key=str)


def random_case(seed, letters, n=60):
    r = random.Random(seed)
    texts = [(k if k % 7 else None, "".join(r.choice(letters) for _ in range(r.randint(0, 80)))) for k in range(n)]
    cut = lambda x: x[(a := r.randint(0, max(0, len(x) - 1))) : a + r.randint(1, 30)]
    facts = [(k, cut(r.choice(texts)[1])) for k in range(n)] + [(100 + k, "".join(r.choice(letters) for _ in range(r.randint(0, 12)))) for k in range(n)]
    return texts + texts[:5] + [(900, None), (901, "")], facts + facts[:3] + [(500, None), (501, ""), (None, facts[0][1])]


@pytest.mark.parametrize("fold", [True, False])
@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefgh XYZ"), (3, "aé𝒳中 ")])
def test_facts_of_all_lengths(spark, seed, letters, fold):
    texts, facts = random_case(seed, letters)
    t = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    f = spark.createDataFrame(facts, "item_id long, fact string")
    got = sorted(map(tuple, grams.containing_by_grams(t, f, "doc_id", "item_id", ignore_case=fold).collect()), key=str)
    assert got == by_hand(texts, facts, fold)


def test_a_hot_gram_goes_many_ways(spark):
    """All texts share a passage; facts that hold it are sought by what is rare in them."""
    texts = [(k, f"the same long passage everywhere {k}") for k in range(500)]
    facts = [(k, f"everywhere {k}") for k in range(0, 500, 50)] + [(1000, "the same long passage"), (1001, "the same long passage nowhere")]
    t, f = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(facts, "item_id long, fact string")
    assert sorted(map(tuple, grams.containing_by_grams(t, f, "doc_id", "item_id").collect()), key=str) == by_hand(texts, facts, True)


def test_many_facts_take_the_grams(spark, monkeypatch):
    texts, facts = random_case(4, "abcd ")
    t, f = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(facts, "item_id long, fact string")
    for most in ("MOST_FACTS", "MOST_CHARS"):
        monkeypatch.setattr(evaluation, most, 3)
        assert sorted(map(tuple, evaluation.containing(t, f, "doc_id", "item_id").collect()), key=str) == by_hand(texts, facts, True)
        monkeypatch.undo()
    assert sorted(map(tuple, evaluation.containing(t, f, "doc_id", "item_id").collect()), key=str) == by_hand(texts, facts, True)
    assert grams.containing_by_grams(t.limit(0), f, "doc_id", "item_id").count() == 0
    assert grams.containing_by_grams(t, f.limit(0), "doc_id", "item_id").count() == 0
