"""Keyword ranking, fusion of rankings, reranking and the semantic cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..sources.scratch import stored
from .postings import top_by_postings
from .retrieve import nearest

K1, B, RRF_K = 1.5, 0.75, 60
#: Queries that are sent to the tasks at most; numbers of a matrix that a task holds.
BLOCK, CELLS = 512, 4_000_000
#: Texts whose words a task holds at once.
STEP = 256


def _terms(c: Column, stem: bool) -> Column:
    """Lower-cased words, with ``stem`` without a plural's ending."""
    return F.transform(T.words(F.lower(c)), T.singular) if stem else T.words(F.lower(c))


def _best(found: pd.DataFrame, k: int, query: str, doc: str) -> pd.DataFrame:
    found = found.assign(_r=found["score"].round(9)).sort_values([query, "_r", doc], ascending=[True, False, True], kind="stable")
    return found.groupby(query, sort=False).head(k).drop(columns="_r")


@dataclass
class WordCounts:
    """What ``word_counts`` has read: the queries and ``rows`` (doc_id, len, at: numbers of words, tf), stored."""

    keys: pa.Array
    words: list[list[str]]
    number: dict[str, int]
    rows: DataFrame


def word_counts(queries: DataFrame, docs: DataFrame, query_id: str = "query_id", doc_id: str = "chunk_id", stem: bool = False) -> WordCounts | None:
    """How often each document has the queries' words, and its length: texts are split once, whatever is ranked by it later.

    None if the queries are more than BLOCK, or their words and number make more than a matrix of CELLS: a posting table is made then.
    """
    asked = queries.select(query_id, F.array_distinct(_terms(F.col("query"), stem)).alias("w")).where(F.size("w") > 0)
    many, longest = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
    if many > BLOCK or many * longest > CELLS:
        return None
    few = asked.toArrow().combine_chunks()  # its size was checked
    keys, words = few.column(0).combine_chunks(), few.column(1).to_pylist()
    number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for b in batches:
            for a in range(0, b.num_rows, STEP):
                part = b.slice(a, STEP)
                split = [t.split() if t else () for t in part.column(1).to_pylist()]  # at the same white space as ``words``
                found = [[number[w] for w in ws if w in number] for ws in split]
                row = np.repeat(np.arange(len(split)), np.fromiter(map(len, found), np.int64, len(split)))
                cell, tf = np.unique(row * len(number) + np.fromiter(chain.from_iterable(found), np.int64, len(row)), return_counts=True)
                ends = pa.array(np.searchsorted(cell, np.arange(len(split) + 1) * len(number)), pa.int32())
                at, tf = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (cell % max(1, len(number)), tf))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, split)), pa.int32()), at, tf], ["id", "len", "at", "tf"])

    text = F.array_join(_terms(F.col("text"), True), " ") if stem else F.lower("text")
    rows = docs.select(F.col(doc_id).alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return WordCounts(keys, words, number, stored(rows.mapInArrow(count, f"id {kind}, len int, at array<int>, tf array<int>"), "word-counts"))


def _top_by_words(queries: DataFrame, docs: DataFrame, k: int, k1: float, b: float, query_id: str, doc_id: str, counted: bool, stem: bool = False, counts: WordCounts | None = None) -> DataFrame:
    """query_id, doc_id, score: for each task and query the ``k`` best documents, by BM25, or by the number of shared words.

    Where there are ``word_counts``, tasks score their documents against all queries as one matrix product (documents by words, words by
    queries) and keep ``k`` a query, so no word and no pair is shuffled. Else a posting table is made. Both give the same rows.
    """
    spark = docs.sparkSession
    counts = counts or word_counts(queries, docs, query_id, doc_id, stem)
    if counts is None:
        return top_by_postings(queries, docs, k, k1, b, query_id, doc_id, _terms(F.col("text"), stem), _terms(F.col("query"), stem), counted)
    types = {query_id: queries.schema[query_id].dataType.simpleString(), doc_id: docs.schema[doc_id].dataType.simpleString()}
    schema = f"{query_id} {types[query_id]}, {doc_id} {types[doc_id]}, score double"
    if not len(counts.keys):
        return spark.createDataFrame([], schema)
    rows, number = counts.rows, counts.number
    mean, idf = 0.0, np.ones(len(number))
    if counted:
        n, mean = rows.agg(F.count("*"), F.avg("len")).first()
        for r in rows.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect():  # a row per word of the queries
            idf[r["at"]] = np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    sent = spark.sparkContext.broadcast((counts.keys, [[number[w] for w in ws] for ws in counts.words], idf))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, idf = sent.value
        has = np.zeros((len(idf), len(keys)))
        for q, ws in enumerate(words):
            has[ws, q] = 1.0
        kept = None
        step = max(1, CELLS // max(len(idf), len(keys)))
        for batch in batches:
            kind = batch.schema.types[0]
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                ids = np.array([*part.column(0).to_pylist(), None], object)[:-1]
                size = part.column(1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(ids)), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                at, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                weight = np.zeros((len(ids), len(idf)))
                weight[row, at] = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean) if mean else 1.0) if counted else 1.0
                scores = weight @ has
                least = np.partition(scores, -k, axis=0)[-k] if len(ids) > k else np.zeros(len(keys))
                r, q = np.nonzero((scores > 0) & (scores >= least - 1e-8))  # those that rounding may tie come along
                found = pd.DataFrame({query_id: q, doc_id: ids[r], "score": scores[r, q]})
                kept = _best(found if kept is None else pd.concat([kept, found]), k, query_id, doc_id)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(kept[query_id].to_numpy(np.int64))), pa.array(kept[doc_id].tolist(), kind), pa.array(kept["score"])], [query_id, doc_id, "score"])

    return rows.mapInArrow(score, schema)


def _ranked(scored: DataFrame, k: int | None, query_id: str, doc_id: str) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.round("score", 9).desc(), doc_id)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int | None = 5, k1: float = K1, b: float = B, query_id: str = "query_id", doc_id: str = "chunk_id", stem: bool = False, counts: WordCounts | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by BM25 over lower-cased (and with ``stem`` singular) words; ``k`` None keeps all
    matches, as joins by word. ``counts``: of these queries and documents, if they were made before."""
    if k is not None:
        return _ranked(_top_by_words(queries, docs, k, k1, b, query_id, doc_id, True, stem, counts), k, query_id, doc_id)
    terms = queries.select(query_id, F.explode(F.array_distinct(_terms(F.col("query"), stem))).alias("term"))
    d = docs.select(doc_id, _terms(F.col("text"), stem).alias("w")).withColumn("len", F.size("w"))
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    wanted = terms.select("term").distinct()
    tf = d.select(doc_id, "len", F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy(doc_id, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(df, "term").join(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = rows.select(doc_id, "term", weight.alias("weight")).join(terms, "term").groupBy(query_id, doc_id).agg(F.sum("weight").alias("score"))
    return _ranked(scored, None, query_id, doc_id)


def shared_words(queries: DataFrame, docs: DataFrame, k: int = 5, query_id: str = "query_id", doc_id: str = "chunk_id", counts: WordCounts | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the ``k`` documents that have most of the query's words."""
    return _ranked(_top_by_words(queries, docs, k, K1, B, query_id, doc_id, False, counts=counts), k, query_id, doc_id)


def fused(rankings: list[DataFrame], k: int | None = None, rrf_k: int = RRF_K, query_id: str = "query_id", doc_id: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion: score is the sum of 1 / (rrf_k + rank) over rankings."""
    rows = rankings[0].select(query_id, doc_id, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(query_id, doc_id, "rank"))
    scored = rows.groupBy(query_id, doc_id).agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.round("score", 12).desc(), doc_id)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """The stand-in of a cross encoder: share of the query's words that the text has."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        words = set(q.lower().split())
        out.append(len(words & set(t.lower().split())) / max(1, len(words)))
    return out


def rerank(found: DataFrame, k: int, score: Callable[[list[str], list[str]], list[float]] | None = overlap_scorer) -> DataFrame:
    """The best ``k`` of each query by a scoring function over (query, text); without one the first ``k`` as they are."""
    if score is None:
        return found.where(F.col("rank") <= k)

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score(q.fillna("").tolist(), t.fillna("").tolist()))

    scored = found.withColumn("rerank_score", run(F.col("query"), F.col("text")))
    w = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cache_lookup(queries: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """query_id, entry_id (null: no hit), similarity: the nearest cached entry of the same scope, if near enough.

    ``entries`` has entry_id, scope and embedding; ``queries`` query_id, scope and embedding.
    """
    best = nearest(entries, queries, 1, "entry_id", "scope").join(queries.select("query_id", "scope"), ["query_id", "scope"])
    hit = best.where(1 - F.col("distance") >= threshold).select("query_id", "entry_id", (1 - F.col("distance")).alias("similarity"))
    return queries.select("query_id").join(hit, "query_id", "left")


def labelled_chunk(page: str = "page_number", heading: str = "section_heading", text: str = "text"):
    """Text with its page and section in front, as the earlier pipeline stored it."""
    head = F.when(F.coalesce(F.col(heading), F.lit("")) != "", F.format_string('[Page %d, Section "%s"] ', F.col(page), F.col(heading))).when(F.col(page) > 0, F.format_string("[Page %d] ", F.col(page))).otherwise("")
    return F.concat(head, F.col(text))
