"""Nearest neighbours and chunks without shuffles of vectors or texts."""

import os

import numpy as np
from pyspark.sql import functions as F

from quarryspark.operators import chunking, retrieve
from quarryspark.sources.scratch import shared_dir


def test_many_queries_are_exact_and_shuffle_no_vectors(spark, monkeypatch):
    r = np.random.default_rng(3)
    vectors = [(None if i == 7 else f"c{i}", None if i % 5 == 4 else f"g{i % 5 % 2}", [float(x) for x in r.integers(-1, 2, 3)]) for i in range(300)]
    asked = [(i, [float(x) for x in r.integers(-1, 2, 3)]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None)]
    v = spark.createDataFrame(vectors, "chunk_id string, source_type string, embedding array<float>").repartition(6)
    q = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    want = set()
    for i, a in asked[:-1]:
        a = np.array(a)
        by = {}
        for name, group, b in vectors:
            b = np.array(b)
            if b.any():
                d = 1 - (a / max(np.linalg.norm(a), 1e-300)) @ b / np.linalg.norm(b)
                by.setdefault(group, []).append((round(d, 9), name or "", name))
        want |= {(i, g, n, rank) for g, found in by.items() for rank, (_, _, n) in enumerate(sorted(found)[:4], 1)}
    there = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    monkeypatch.setattr(retrieve, "ROWS", 16)
    got = {(x["query_id"], x["source_type"], x["chunk_id"], x["rank"]) for x in retrieve.nearest(v, q, 4).collect()}
    assert got == want
    made = set(os.listdir(shared_dir(spark).removeprefix("file://"))) - there
    assert made and all(x.startswith("nearest-") for x in made)  # neighbours only, no copies of vectors


def test_sources_of_one_segment_are_numbered_where_they_are(spark):
    rows = [(str(i), 0, " \n" if i == 3 else f"word{i} " * 400, 1) for i in range(6)]
    one = spark.createDataFrame(rows, "source_id string, seg_idx int, text string, page_number int")
    chunks = chunking.chunk_documents(one)
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    several = chunking.chunk_documents(one.unionByName(one.limit(1).withColumns({"source_id": F.lit("x"), "text": F.lit("more")})).unionByName(one.limit(1).withColumns({"source_id": F.lit("x"), "seg_idx": F.lit(1), "text": F.lit("still more")})))
    form = lambda df: sorted((x["source_id"], x["chunk_index"], x["text"]) for x in df.where("source_id <> 'x'").collect())
    assert form(chunks) == form(several) and chunks.where("chunk_index > 0").count() > 0
    assert sorted((x["chunk_index"], x["text"]) for x in several.where("source_id = 'x'").collect()) == [(0, "more"), (1, "still more")]
