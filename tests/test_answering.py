"""Retrieval, contexts, replies, the loop, frames, evaluation and ranking."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarryspark import schemas
from quarryspark.functions import replies as R
from quarryspark.functions import text as T
from quarryspark.functions.vectors import cosine_distance
from quarryspark.operators import context, evaluation, ranking, retrieve
from quarryspark.plans import agent
from quarryspark.sources import models, sse


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("p0", "p", "pdf", 0, "same", [1.0, 0.0], "doc.pdf", 5, None, None),
        ("p1", "p", "pdf", 1, "pdf text", [0.8, 0.6], "doc.pdf", 6, None, None),
        ("w0", "w", "web", 0, "same", [0.9, 0.1], None, None, "T", "http://w"),
        ("w1", "x", "web", 0, "other", [0.0, 1.0], None, None, "T", "http://x"),
        ("y0", "y", "youtube", 0, "no vector", None, None, None, "V", None),
    ]
    return schemas.conform(spark.createDataFrame(rows, "chunk_id string, source_id string, source_type string, chunk_index int, text string, embedding array<float>, filename string, page_number int, title string, url string"), schemas.CHUNKS)


def ask(spark, sources, ids=None, user=None):
    return spark.createDataFrame([(1, [1.0, 0.0], sources, ids, user)], "query_id long, embedding array<float>, sources_to_use array<string>, source_ids array<string>, sources array<string>")


def found(df):
    return [(r.chunk_id, r.source_pos, r["rank"]) for r in df.orderBy("source_pos", "rank").collect()]


def test_retrieval_order_and_dedup(spark, chunks):
    assert found(retrieve.retrieve(ask(spark, ["pdf", "web"]), chunks)) == [("p0", 0, 1), ("p1", 0, 2), ("w1", 1, 2)]
    assert found(retrieve.retrieve(ask(spark, ["web", "pdf", "web"]), chunks)) == [("w0", 0, 1), ("w1", 0, 2), ("p1", 1, 2)]
    assert found(retrieve.retrieve(ask(spark, ["pdf"]), chunks, k=1)) == [("p0", 0, 1)]


def test_retrieval_filters(spark, chunks):
    assert found(retrieve.retrieve(ask(spark, ["pdf", "web", "database"], ["x"]), chunks)) == [("w1", 1, 1)]
    assert found(retrieve.retrieve(ask(spark, ["pdf", "web"], []), chunks)) == found(retrieve.retrieve(ask(spark, ["pdf", "web"]), chunks))
    assert found(retrieve.retrieve(ask(spark, ["pdf", "web"], None, ["web"]), chunks, enforce_user_sources=True)) == [("w0", 0, 1), ("w1", 0, 2)]
    none = ask(spark, ["pdf"]).withColumn("embedding", F.lit(None).cast("array<float>"))
    assert retrieve.retrieve(none, chunks).count() == 0


def test_nearest_equals_plain_distances(spark):
    r = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(200)]
    v = spark.createDataFrame(rows, "chunk_id long, source_type int, embedding array<float>").repartition(5)
    q = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = {(x.query_id, x.source_type, x["rank"]): (x.chunk_id, x.distance) for x in retrieve.nearest(v, q, 4).collect()}
    pairs = v.crossJoin(q.withColumnRenamed("embedding", "e")).withColumn("d", cosine_distance(F.col("embedding"), F.col("e"))).where("d is not null").collect()
    by = {}
    for x in pairs:
        by.setdefault((x.query_id, x.source_type), []).append((x.d, x.chunk_id))
    assert len(got) == 4 * len(by)
    for (query, kind, rank), (_, d) in got.items():
        assert abs(sorted(by[query, kind])[rank - 1][0] - d) < 1e-9 and -1e-9 <= d <= 2 + 1e-9


def test_blocks_of_queries(spark, chunks, monkeypatch):
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "query_id long, embedding array<float>")
    whole = sorted(map(tuple, retrieve.nearest(chunks, q, 1).collect()))
    monkeypatch.setattr(retrieve, "BLOCK", 2)
    assert sorted(map(tuple, retrieve.nearest(chunks, q, 1).collect())) == whole


def test_zipped_arrays(spark):
    d = spark.createDataFrame([(1, ["a", "b"], ["m", "n"], [0.1, 0.2])], "q int, documents array<string>, metadatas array<string>, distances array<double>")
    assert [tuple(r) for r in retrieve.zipped("documents", "metadatas", "distances", d, "q").collect()] == [(1, 0, "a", "m", 0.1), (1, 1, "b", "n", 0.2)]


def test_labels_and_context(spark, chunks):
    null = F.lit(None)
    assert value(spark, T.citation_label(F.lit("pdf"), F.lit("doc.pdf"), F.lit(5), null, null, null)) == "[PDF — doc.pdf p.5]"
    assert value(spark, T.citation_label(F.lit("youtube"), null, null, F.lit("V"), F.lit(30), null)) == "[YouTube — V @30s]"
    assert value(spark, T.citation_label(F.lit("web"), null, null, null, null, null)) == "[Web — ]"
    lists = retrieve.retrieved_lists(retrieve.retrieve(ask(spark, ["pdf"]), chunks))
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: r.context for r in context.with_context(q, lists).collect()}
    assert got == {1: "[PDF — doc.pdf p.5]\nsame\n\n---\n\n[PDF — doc.pdf p.6]\npdf text", 2: "No context retrieved."}


def test_citation_parser(spark):
    t = F.lit("See [PDF — a.pdf p.1], [web - http://x ] and [YouTube – v @3s] but not [Other — y].")
    assert value(spark, T.citations(t)) == ["a.pdf p.1", "http://x", "v @3s"]
    assert value(spark, T.citation_kinds(t)) == ["PDF", "web", "YouTube"]


ALL = ["pdf", "youtube", "web"]


@pytest.mark.parametrize("reply,sources,query", [
    ('{"sources_to_use": ["pdf", "web"], "rewritten_query": "r"}', ["pdf", "web"], "r"), ("not valid json", ALL, "q"), ('{"sources_to_use": ["pdf", "database"]}', ["pdf"], "q"),
    ('{"sources_to_use": [], "rewritten_query": "r"}', ALL, "r"), ("{'sources_to_use': ['pdf']}", ALL, "q"), ('{"sources_to_use": ["pdf"]} extra', ALL, "q"), ("[1]", ALL, "q"), ('```json\n{"sources_to_use": ["pdf"]}\n```', ALL, "q"), ("{}", ALL, "q"), (None, ALL, "q"), ('{"sources_to_use": ["web", "web"]}', ["web", "web"], "q"),
])
def test_planner_replies(spark, reply, sources, query):
    s, q = R.planner_reply(F.lit(reply).cast("string"), F.lit("q"))
    assert tuple(spark.range(1).select(s, q).first()) == (sources, query)


@pytest.mark.parametrize("reply,poor,feedback", [('{"quality": "good", "feedback": "x"}', False, ""), ('{"quality": "poor", "feedback": "more"}', True, "more"), ('{"quality": "poor"}', True, ""), ("nonsense", False, ""), ('{"quality": "bad"}', False, "")])
def test_critic_replies(spark, reply, poor, feedback):
    assert tuple(spark.range(1).select(*R.critic_reply(F.lit(reply))).first()) == (poor, feedback)


def test_prompts(spark):
    p = value(spark, R.planner_prompt(F.lit("what {feedback}?"), F.lit("")))
    assert "Question: what {feedback}?" in p and "answer: none" in p


def test_loop(spark, chunks, tmp_path):
    log = str(tmp_path / "critic")

    def planner(prompts, _):
        return ['{"sources_to_use": ["pdf"], "rewritten_query": "again"}' if "too short" in p else '{"sources_to_use": ["web"]}' for p in prompts]

    def critic(prompts, _):
        with open(log, "a") as f:
            f.write("x\n" * len(prompts))
        return ['{"quality": "poor", "feedback": "too short"}' if "second" in p else '{"quality": "good"}' for p in prompts]

    m = agent.Models(planner, models.first_context_answer, critic, lambda: lambda texts: np.tile(np.array([[1.0, 0.0]], np.float32), (len(texts), 1)))
    q = spark.createDataFrame([(1, "first"), (2, "second")], "query_id long, query string")
    got = {r.query_id: r for r in agent.answer(q, chunks, m).collect()}
    assert (got[1].iteration, got[1].query, got[1].needs_replan, got[1].sources_to_use) == (1, "first", False, ["web"])
    assert (got[2].iteration, got[2].query, got[2].original_query, got[2].needs_replan, got[2].critic_feedback, got[2].sources_to_use) == (2, "again", "second", False, "", ["pdf"])
    assert got[1].answer.startswith("[Web — http://w]\nsame") and got[2].answer.startswith("[PDF — doc.pdf p.5]")
    assert open(log).read().count("x") == 2  # one critic call a query; none in the second pass
    rows = {(r.conversation_id, r.role): r.content for r in agent.messages(agent.answer(q, chunks, m), F.lit("2026-01-01").cast("timestamp")).collect()}
    assert rows["2", "user"] == "second" and len(rows) == 4


def test_loop_without_sources_or_embedder(spark, chunks):
    def broken():
        raise OSError

    q = spark.createDataFrame([(1, "x")], "query_id long, query string")
    r = agent.answer(q, chunks, agent.Models(load_embedder=broken)).first()
    assert (r.context, r.retrieved_chunks, r.iteration) == ("No context retrieved.", [], 2)


def test_frames_and_parser(spark):
    d = spark.createDataFrame([(1, " Attention is\n a  mechanism. "), (2, "")], "k int, t string")
    f = sse.frames(d, "k", "t")
    assert [r.frame for r in f.where("k = 1").orderBy("pos").collect()] == ["data: Attention \n\n", "data: is \n\n", "data: a \n\n", "data: mechanism. \n\n", "data: [DONE]\n\n"]
    wire = f.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "frame"))), lambda x: x["frame"]), "").alias("t"))
    back = {r.k: r.text for r in sse.joined(sse.parsed(wire, "k", "t"), "k").collect()}
    assert back == {1: "Attention is a mechanism. "}
    with pytest.raises(PySparkException):
        sse.parsed(spark.createDataFrame([(1, "data: a\n\ndata: [ERROR] x\n\n")], "k int, t string"), "k", "t").collect()
    late = spark.createDataFrame([(1, "data: a\n\ndata: [DONE]\n\ndata: [ERROR]\n\n")], "k int, t string")
    assert [r.data for r in sse.parsed(late, "k", "t").collect()] == ["a"]


def test_deltas_and_models(spark):
    d = spark.createDataFrame([("hello",), (" world",), (None,), ("",)], "delta string")
    assert [r.delta for r in sse.deltas(d).collect()] == ["hello", " world"]
    assert [r.a for r in d.select(models.completed(F.col("delta"), lambda p, n: [None] * len(p)).alias("a")).collect()] == [""] * 4


def test_measures(spark):
    d = spark.createDataFrame([(1,), (2,), (None,), (4,)], "rank int")
    q = evaluation.quality(d).first()
    assert (q.mrr, q.hit_at_1, q.hit_at_3) == ((1 + 0.5 + 0.25) / 4, 0.25, 0.5)
    e = evaluation.quality(d.where("1 = 0")).first()
    assert (e.mrr, e.hit_at_1) == (0, 0)
    v = spark.createDataFrame([(float(x),) for x in range(1, 5)], "ms double")
    p = evaluation.latency(v, "ms").first()
    assert (p.p50, round(p.p95, 6), p["mean"]) == (2.5, 3.85, 2.5)
    assert evaluation.latency(v.where("1 = 0"), "ms").first().p99 == 0
    a = spark.createDataFrame([([1, 2], [1, 3]), ([1], [1]), ([2, 1], [1, 2])], "a array<int>, b array<int>")
    r = a.agg(evaluation.reorder_rate(F.col("a"), F.col("b")).alias("r"), evaluation.top_change_rate(F.col("a"), F.col("b")).alias("t")).first()
    assert (round(r.r, 6), round(r.t, 6)) == (round(2 / 3, 6), round(1 / 3, 6))
    assert value(spark, evaluation.average_of_first(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0, 5.0, 60.0))))) == 3.0
    assert value(spark, evaluation.throughput(F.lit(4), F.lit(0.0))) == 0 and value(spark, evaluation.throughput(F.lit(4), F.lit(2.0))) == 2
    c = spark.createDataFrame([(True, 10.0, 2.0), (False, 10.0, 2.0)], "hit boolean, cold_ms double, cached_ms double")
    assert tuple(evaluation.cache_report(c).first()) == (0.5, 5.0) and tuple(evaluation.cache_report(c.where("1 = 0")).first()) == (0, 0)


def test_truth_search(spark):
    chunks = spark.createDataFrame([(0, "no"), (1, "the ALPHA text"), (2, "alpha")], "chunk_index int, text string")
    facts = spark.createDataFrame([("f", "Alpha"), ("g", "none"), ("h", "")], "fact_id string, keyword string")
    assert [tuple(r) for r in evaluation.first_chunks(chunks, facts).collect()] == [("f", 1)]
    assert value(spark, evaluation.keyword(F.lit("The cost to acquire a customer"))) == "a"
    found = spark.createDataFrame([(1, 1, "nothing"), (1, 2, "REVENUE rose"), (2, 1, "x")], "query_id int, rank int, text string")
    truth = spark.createDataFrame([(1, "[Page 1] The revenue was big"), (2, "[Page 2] Something else")], "query_id int, snippet string")
    assert {tuple(r) for r in evaluation.first_matching_rank(found, truth).collect()} == {(1, 2), (2, None)}


def test_ranking(spark):
    d = spark.createDataFrame([("a", "apple pie"), ("b", "apple apple tart"), ("c", "plum")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "Apple tart")], "query_id int, query string")
    got = [r.chunk_id for r in ranking.bm25(q, d).orderBy("rank").collect()]
    assert got == ["b", "a"]
    x = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    y = spark.createDataFrame([(1, "b", 1)], "query_id int, chunk_id string, rank int")
    f = ranking.fused([x, y]).orderBy("rank").collect()
    assert [r.chunk_id for r in f] == ["b", "a"] and abs(f[0].score - (1 / 62 + 1 / 61)) < 1e-12
    found = spark.createDataFrame([(1, "red apple", "green pear", 1), (1, "red apple", "red apple", 2)], "query_id int, query string, text string, rank int")
    assert [r.text for r in ranking.rerank(found, 1).collect()] == ["red apple"]
    assert [r.text for r in ranking.rerank(found, 1, None).collect()] == ["green pear"]
    assert value(spark, F.lit(1)) == 1
    c = spark.createDataFrame([(2, "S", "t"), (3, None, "u"), (0, "", "v")], "page_number int, section_heading string, text string")
    assert [r.x for r in c.select(ranking.labelled_chunk().alias("x")).collect()] == ['[Page 2, Section "S"] t', "[Page 3] u", "v"]


def test_formats(spark):
    assert [value(spark, T.format_ms(F.lit(x))) for x in (4.846, 1500.0)] == ["4.8 ms", "1.50 s"]
    assert [value(spark, T.format_bytes(F.lit(x))) for x in (512, 2048, 3 * 1024**2)] == ["512.0 B", "2.0 KB", "3.0 MB"]
    assert [value(spark, T.size_label(F.lit(x))) for x in (10, 1024)] == ["10 KB", "1 MB"]
    assert value(spark, T.suffix(F.lit("a.b/c.tar.gz"))) == ".gz" and value(spark, T.suffix(F.lit("x"))) == ".bin" and value(spark, T.suffix(F.lit(None).cast("string"))) == ".bin"
    assert value(spark, T.display_date(F.lit("2026-05-11T08:09:00+00:00"))) == "May 11 08:09" and value(spark, T.display_date(F.lit("x"))) == ""
    assert value(spark, T.escape_html(F.lit("<a & b>"))) == "&lt;a &amp; b&gt;"
    assert value(spark, T.words(F.lit(" a  b\n"))) == ["a", "b"] and value(spark, T.is_blank(F.lit(" \n"))) and value(spark, T.is_blank(F.lit(None).cast("string")))
    assert value(spark, T.collection_type(F.lit("pdf_chunks"))) == "pdf" and len(value(spark, T.content_id(F.lit("x")))) == 36


def test_words_without_plural_endings(spark):
    from quarryspark.functions import text as T

    words = ["queries", "eies", "houses", "shoes", "cats", "bus", "boss", "axis", "cat", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.singular(F.col("w"))).collect()
    assert [r[0] for r in got] == ["query", "eies", "house", "shoes", "cat", "bus", "boss", "axis", "cat", ""]


def test_bm25_with_stemming_finds_plurals(spark):
    q = spark.createDataFrame([(1, "report")], "query_id int, query string")
    d = spark.createDataFrame([("a", "two reports"), ("b", "nothing")], "chunk_id string, text string")
    assert [r.chunk_id for r in ranking.bm25(q, d, stem=True).collect()] == ["a"] and ranking.bm25(q, d).count() == 0


def test_top_k_equals_all_matches(spark):
    q = spark.createDataFrame([(1, "a b c"), (2, "c c d"), (3, "zz"), (4, "")], "query_id int, query string")
    d = spark.createDataFrame([(f"d{i}", " ".join("abcdefg"[(i * k) % 7] for k in range(i % 9))) for i in range(60)], "chunk_id string, text string").repartition(3)
    form = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in df.collect())
    assert form(ranking.bm25(q, d, 7)) == form(ranking.bm25(q, d, None).where("rank <= 7"))
