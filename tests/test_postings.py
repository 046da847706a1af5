"""The posting table against all matches, and that blocks are passed over."""

import random

import pytest
from pyspark.sql import functions as F

from quarryspark.operators import postings, ranking


@pytest.fixture(scope="module")
def corpus():
    """Words of Zipf's law, so that long lists say little."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(2000)]
    weight = [1 / (k + 1) for k in range(2000)]
    docs = [(k, " ".join(r.choices(words, weight, k=r.randint(1, 60)))) for k in range(1500)]
    queries = [(k, " ".join(r.choices(words, weight, k=r.randint(1, 12)))) for k in range(40)] + [(90, ""), (91, "nowhere"), (92, "W0 w0 w1"), (93, None)]
    return docs + [(5000, None), (5001, ""), (5002, docs[3][1]), (5003, docs[3][1])], queries + [(94, " ".join(words))]


def rows(found, k):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in found.collect() if r["rank"] <= k)


@pytest.mark.parametrize("k,block,lead", [(1, 128, 6), (5, 8, 2), (40, 16, 6)])
def test_equals_all_matches(spark, corpus, monkeypatch, k, block, lead):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "LEAD", lead)
    docs = spark.createDataFrame(corpus[0], "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame(corpus[1], "query_id long, query string")
    every = ranking.bm25(queries, docs, None)
    monkeypatch.setattr(ranking, "BLOCK", 3)
    assert rows(ranking.bm25(queries, docs, k), k) == rows(every, k)


def test_long_queries_and_shared_words(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus[0], "chunk_id long, text string")
    queries = spark.createDataFrame(corpus[1], "query_id long, query string")
    few = rows(ranking.shared_words(queries, docs, 4), 4)
    monkeypatch.setattr(ranking, "CELLS", 10)
    assert rows(ranking.shared_words(queries, docs, 4), 4) == few


def test_blocks_are_passed_over(spark, corpus, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    d = spark.createDataFrame([r for r in corpus[0] if r[1]], "doc long, text string").select("doc", F.split("text", " ").alias("w"))
    q = spark.createDataFrame([r for r in corpus[1][:40]], "query long, text string").select("query", F.array_distinct(F.split("text", " ")).alias("w"))
    table = postings.PostingTable(d, ranking.K1, ranking.B)
    _, report = table.search(q, 3)
    total = report.agg(F.sum("blocks"), F.sum("read")).first()
    assert total[1] < total[0] * 0.6
    blocks = table.blocks.collect()
    assert max(b["n"] for b in blocks) <= 8 and all(b["weights"] == sorted(b["weights"], reverse=True) and (b["most"], b["least"], b["n"]) == (b["weights"][0], b["weights"][-1], len(b["docs"])) for b in blocks)
    assert sum(b["n"] for b in blocks) == table.flat.count()
    table.drop()


def test_empty_sides(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "chunk_id long, text string"), spark.createDataFrame([], "query_id long, query string")
    words = lambda c: F.split(c, " ")
    for d, q in ((docs, none), (docs.limit(0), spark.createDataFrame([(1, "a")], "query_id long, query string"))):
        assert postings.top_by_postings(q, d, 3, 1.5, 0.75, "query_id", "chunk_id", words("text"), words("query"), True).count() == 0
