"""Measures of retrieval quality and speed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import selection
from .grams import containing_by_grams


def mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def percentile(c: Column, p: float) -> Column:
    """Exact, with linear interpolation; 0 of nothing."""
    return F.coalesce(F.percentile(c, F.lit(p)), F.lit(0.0))


#: Rows whose percentiles a plain aggregate takes: it holds a group's distinct values in one task.
HELD = 1_000_000


def latency(rows: DataFrame, value: str, by: list[str] | None = None, held: int = HELD) -> DataFrame:
    """Count, mean and exact percentiles (with linear interpolation) per group; of more than ``held`` rows by distributed selection."""
    c, by = F.col(value), by or []
    if rows.count() <= held:
        return rows.groupBy(*by).agg(F.count(c).alias("n"), mean(c).alias("mean"), F.coalesce(F.median(c), F.lit(0.0)).alias("p50"), percentile(c, 0.95).alias("p95"), percentile(c, 0.99).alias("p99"))
    g = F.struct(F.lit(0).alias("all"), *by)
    sums = rows.groupBy(g.alias("g")).agg(F.count(c).alias("n"), mean(c).alias("mean"))
    found = selection.percentiles(rows.select(g.alias("g"), c.cast("double").alias("v")), {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed("g", "of")
    out = sums.join(found, F.col("g") == F.col("of"), "left")
    return out.select(*[F.col("g")[b].alias(b) for b in by], "n", "mean", *[F.coalesce(p, F.lit(0.0)).alias(p) for p in ("p50", "p95", "p99")])


def throughput(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))


def mrr(rank: Column) -> Column:
    return mean(F.coalesce(1.0 / rank, F.lit(0.0)))


def hit_at(rank: Column, k: int) -> Column:
    return mean(F.when(rank <= k, 1.0).otherwise(0.0))


def quality(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """mrr, hit_at_1, hit_at_3 over queries whose truth is known; a null rank is a miss."""
    c = F.col(rank)
    return ranks.agg(F.count("*").alias("queries"), mrr(c).alias("mrr"), hit_at(c, 1).alias("hit_at_1"), hit_at(c, 3).alias("hit_at_3"))


def reorder_rate(a: Column, b: Column) -> Column:
    """Share of queries whose lists differ anywhere."""
    return mean((a != b).cast("double"))


def top_change_rate(a: Column, b: Column) -> Column:
    """Share of queries whose first items differ."""
    return mean((~F.try_element_at(a, F.lit(1)).eqNullSafe(F.try_element_at(b, F.lit(1)))).cast("double"))


def average_of_first(scores: Column, n: int = 5) -> Column:
    """Mean of the first ``n`` of an array of scores, 0 of none."""
    first = F.slice(scores, 1, n)
    return F.when(F.size(first) > 0, F.aggregate(first, F.lit(0.0), lambda s, x: s + x) / F.size(first)).otherwise(F.lit(0.0))


def cache_report(lookups: DataFrame) -> DataFrame:
    """hit_rate and speedup from hit, cold_ms, cached_ms; 0 where nothing can be divided."""
    return lookups.agg(mean(F.col("hit").cast("double")).alias("hit_rate"), F.coalesce(F.try_divide(F.avg("cold_ms"), F.avg("cached_ms")), F.lit(0.0)).alias("speedup"))


#: Facts, and their characters, that are sent to all tasks at most.
MOST_FACTS, MOST_CHARS = 100_000, 16_000_000


def containing(texts: DataFrame, facts: DataFrame, text_id: str, fact_id: str, text: str = "text", fact: str = "fact", ignore_case: bool = True) -> DataFrame:
    """(fact_id, text_id) for every text that contains a fact. Few facts go to the tasks as one automaton that reads each
    text once; more meet the texts by their rarest grams. Both give the same rows."""
    spark = texts.sparkSession
    types = {text_id: texts.schema[text_id].dataType.simpleString(), fact_id: facts.schema[fact_id].dataType.simpleString()}
    given = facts.where(F.col(fact).isNotNull() & (F.col(fact) != ""))
    many, chars = given.agg(F.count("*"), F.coalesce(F.sum(F.char_length(fact)), F.lit(0))).first()
    if many > MOST_FACTS or chars > MOST_CHARS:
        return containing_by_grams(texts, facts, text_id, fact_id, text, fact, ignore_case)
    if not many:
        return spark.createDataFrame([], f"{fact_id} {types[fact_id]}, {text_id} {types[text_id]}")
    rows = [(r[0], r[1].lower() if ignore_case else r[1]) for r in given.select(fact_id, fact).collect()]  # their size was checked
    sent = spark.sparkContext.broadcast(rows)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        by_word: dict[str, list] = {}
        for i, w in sent.value:
            by_word.setdefault(w, []).append(i)
        automaton = ahocorasick.Automaton()
        for w in by_word:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for b in batches:
            out = []
            for i, t in zip(b[text_id], b[text], strict=True):
                if isinstance(t, str):
                    out += [(f, i) for w in {w for _, w in automaton.iter(t.lower() if ignore_case else t)} for f in by_word[w]]
            yield pd.DataFrame(out, columns=[fact_id, text_id])

    return texts.select(text_id, text).mapInPandas(scan, f"{fact_id} {types[fact_id]}, {text_id} {types[text_id]}")


def first_chunks(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """fact_id, chunk_index of the first chunk that contains each fact's keyword (fact_id, keyword)."""
    hits = containing(chunks, facts, "chunk_index", "fact_id", fact="keyword")
    return hits.groupBy("fact_id").agg(F.min("chunk_index").alias("chunk_index"))


def keyword(sentence: Column) -> Column:
    return T.nth_word(sentence, 5)


def first_matching_rank(found: DataFrame, truths: DataFrame) -> DataFrame:
    """query_id, rank: of the first retrieved text that has a longer word of the truth's snippet; null if none.

    ``found`` has query_id, rank, text; ``truths`` has query_id, snippet.
    """
    t = truths.select("query_id", T.snippet_words(F.col("snippet")).alias("_words"))
    hit = F.exists("_words", lambda w: T.contains_ignoring_case(F.col("text"), w))
    ranks = t.join(found, "query_id", "left").withColumn("rank", F.when(hit, F.col("rank")))
    return ranks.groupBy("query_id").agg(F.min("rank").alias("rank"))
