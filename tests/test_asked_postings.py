"""A posting table for given queries holds the postings of their words only; scores are those of all documents and lengths."""

from pyspark.sql import functions as F

from quarryspark.operators import postings


def test_only_asked_words(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a d e"), (3, "f"), (4, "")], "doc long, t string").select("doc", F.filter(F.split("t", " "), lambda x: x != "").alias("w"))
    whole, part = postings.PostingTable(docs, 1.5, 0.75), postings.PostingTable(docs, 1.5, 0.75, True, spark.createDataFrame([("a",), ("f",), ("z",)], "term string"))
    rows = lambda t: sorted((r.term, r.doc, round(r.weight, 12)) for r in t.flat.collect())
    assert rows(part) == [r for r in rows(whole) if r[0] in "af"] and len(rows(part)) == 3
    assert {r.term: r.df for r in part.terms.collect()} == {"a": 2, "f": 1}
    whole.drop()
    part.drop()
