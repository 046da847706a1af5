"""Rankings by words read the texts once."""

from pyspark.sql import functions as F

from quarryspark.operators import ranking


def test_two_rankings_read_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    texts = ["Apple pie and APPLE tart", None, " \n", "plum pie pie", "nothing at all", "tart\x1fplum"]
    plain = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    docs = plain.withColumn("text", seen.asNondeterministic()("text"))
    queries = spark.createDataFrame([(1, "apple pie"), (2, "plum"), (3, " "), (4, "zz")], "query_id int, query string")
    counts = ranking.word_counts(queries, docs)
    form = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    found, shared = form(ranking.bm25(queries, docs, 3, counts=counts)), form(ranking.shared_words(queries, docs, 3, counts=counts))
    assert read.value == len(texts)
    assert found == form(ranking.bm25(queries, plain, None).where("rank <= 3"))
    assert shared == [(1, "d0", 2.0, 1), (1, "d3", 1.0, 2), (2, "d3", 1.0, 1), (2, "d5", 1.0, 2)]


def test_counts_of_many_texts_and_of_no_query(spark, monkeypatch):
    monkeypatch.setattr(ranking, "STEP", 3)
    docs = spark.createDataFrame([(i, " ".join(["a", "b", "c"][: i % 4] * 2)) for i in range(20)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "c a")], "query_id int, query string")
    rows = sorted(map(tuple, ranking.word_counts(queries, docs).rows.collect()))
    at = {"c": 0, "a": 1}
    assert rows == [(i, 2 * (i % 4), sorted(at[w] for w in ["a", "b", "c"][: i % 4] if w in at), [2] * sum(w in at for w in ["a", "b", "c"][: i % 4])) for i in range(20)]
    none = ranking.word_counts(queries.where("query_id = 2"), docs)
    assert none.rows.count() == 20 and ranking.bm25(queries.where("query_id = 2"), docs, 3, counts=none).count() == 0
