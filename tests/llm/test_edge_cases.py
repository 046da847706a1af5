"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryspark.llm import exact_dedup, html_wrappers, language_id, minhash, packing, pii, quality_rules, sentence_pieces, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, digest long, shard string, component string, length string"
LONG = "the long and winding " * 4000 + "end"


def public(name):
    import public_tokenizers

    return public_tokenizers.path(name)


OPERATORS = {
    "pii": pii.find_pii,
    "language": language_id.identify_language,
    "packing": packing.pack,
    "quality": quality_rules.quality_rules,
    "exact": exact_dedup.exact_dedup,
    "pieces": lambda d: sentence_pieces.piece_digests(d, public("piece_bpe_32k.model")),
    "suffix": suffix_dedup.cut_out,
    "sharding": sharding.shard,
    "minhash": minhash.near_duplicates,
}


def rows():
    texts = [None, "", "   ", "A", "a", "The same words here again", "the SAME words here again", LONG, LONG + " x", "x" * 5000, "1234 !? \n\n 99", "é́ ▁ <|endoftext|> 中"]
    out = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "k", 1, "s", "c", "l") for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, "no id", "en", "s", 5, "k", 1, "s", "c", "l")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    got = OPERATORS[name](odd).toPandas()
    assert len(got) == odd.count() + (0 if name != "packing" else (got["piece"] > 0).sum())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_of_odd_rows(odd):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect()}
    assert {(0, 1, 2, False), (1, 1, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 6, 4, False), (6, 6, 4, True)} <= got


def test_smallest_identifier_can_stay(odd):
    got = {(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_dedup(odd, keep="smallest").collect()}
    assert {(0, 0), (1, 0), (6, 5)} <= got


def test_minhash_of_odd_rows(odd):
    got = {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(odd).collect()}
    assert {(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1), (5, 5, 4), (6, 5, 4), (7, 7, 5), (8, 7, 6)} <= got


def test_suffix_of_odd_rows(odd):
    got = {r["doc_id"]: r for r in suffix_dedup.cut_out(odd).collect()}
    assert (got[0]["n_bytes"], got[0]["n_removed"]) == (0, 0)
    assert (got[9]["n_removed"], got[9]["n_spans"]) == (5000 - 1, 1)  # x at 1 starts a string that starts at 0, too
    assert got[5]["n_removed"] == 0


def test_index_flush_and_compaction(spark):
    index = exact_dedup.DigestIndex(spark, keep="smallest")
    index.flush(spark.createDataFrame([(3, "a"), (4, "b")], "doc_id long, text string"))
    index.flush(spark.createDataFrame([(1, "A"), (9, "c")], "doc_id long, text string"))
    before = sorted(map(tuple, index.merged().select("keep_id", "group_size").collect()))
    assert before == [(1, 2), (4, 1), (9, 1)]
    index.compact()
    assert len(index.runs) == 1 and sorted(map(tuple, index.merged().select("keep_id", "group_size").collect())) == before


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, key string, size string, wrapper string"
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>a &amp; b<p>c  d</article><footer>f</footer>"
    odd = spark.createDataFrame([(1, None, None, "h", "k", "s", "w"), (2, "odd", page, "h", "k", "s", "w"), (3, "http://h.example/x", page, "h", "k", "s", "w"), (3, "http://h.example/x", page, "h", "k", "s", "w"), (None, "http://h.example/y", page.replace("c  d", "e"), "h", "k", "s", "w"), (5, "http://h.example/z", "", "h", "k", "s", "w")], schema)
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_wrappers.extract_text(odd).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "T\na & b\nc d", 11), (3, "T\na & b\nc d", 11), (3, "T\na & b\nc d", 11), (None, "T\na & b\ne", 9), (5, "", 0)], key=str)
    assert html_wrappers.extract_text(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert ids == {4, 6, 7, 8, 9, None, 11} - {8}
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == ids
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).where(F.lit(True)).count() == 0


def test_repeated_and_null_ids_in_the_pipeline(spark):
    """A row is judged by its text, not by the company of its doc_id."""
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "h i j k l m n"), (9, "h i j k l m n"), (None, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(corpus_pipeline.exact_duplicates(spark, docs, "").collect())
    assert got == [(5, "a b c d e f g"), (9, "h i j k l m n")]
    base = [f"w{i}" for i in range(60)]
    x, y = " ".join(base), " ".join(w + "y" for w in base)
    near = [(7, x), (7, y), (8, x + " z"), (9, y + " z"), (None, x + " q"), (None, "alone in the world")]
    docs = spark.createDataFrame(near, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_groups(spark, docs, "").collect()}
    assert got == {(7, x), (7, y), (None, "alone in the world")}
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in minhash.near_duplicates(docs).collect())
    assert found == [(0, 0), (0, 7), (7, 7), (7, 7), (8, 7), (9, 7)]
