"""Keyword ranking over a posting table with impact bounds, for queries of any number and length.

The table holds what each word adds to a document's score, per word in blocks of ``BLOCK`` from the greatest impact down, each
block with its greatest and least. Queries stay distributed:

1. The first blocks of a query's ``LEAD`` words of greatest impact give candidates; their full scores give a score that k documents reach.
2. The words of most postings share that score as a budget: a word is passed over wholly if its greatest impact fits, the last one
   down to what is left of it. A document that only passed-over postings speak for can't reach the k-th score, so blocks whose
   greatest impact is within a word's share are never read.
3. Documents of the blocks read that may still reach the score get what they lack from the table.

All steps are joins by (word) or (word, document). Texts are split into words once, when the table is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import drop_stored, stored

BLOCK, LEAD = 128, 6
#: Words of queries that are sent to all tasks at most, and their bytes.
SENT_TERMS, SENT_BYTES = 200_000, 8_000_000
#: Scores that differ by less are equal.
SLACK = 1e-8


class PostingTable:
    """``flat`` (term, doc, weight), ``blocks`` (term, most, least, n, docs, weights), ``terms`` (term, df, top), stored.

    ``docs`` has doc (an identifier of its own per row) and w (array of words). Without ``counted`` each word weighs 1. With ``asked``
    (term, different ones) the table holds the postings of those words only; all words count for the lengths.
    """

    def __init__(self, docs: DataFrame, k1: float, b: float, counted: bool = True, asked: DataFrame | None = None):
        kind = docs.schema["doc"].dataType.simpleString()
        tf = docs.select("doc", F.size("w").alias("len"), F.explode("w").alias("term"))
        tf = (tf if asked is None else tf.join(asked, "term", "left_semi")).groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
        n, mean = docs.agg(F.count("*"), F.avg(F.size("w"))).first()
        if counted:
            tf = stored(tf, "term-counts")
            df = tf.groupBy("term").agg(F.count("*").alias("df"))
            idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))
            rows = tf.join(df, "term").select("term", "doc", weight.alias("weight"))
        else:
            rows = tf.select("term", "doc", F.lit(1.0).alias("weight"))
        self.flat = stored(rows, "postings")
        if counted:
            drop_stored(tf)

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Sorted rows: blocks of one term, which may go on in the next partition."""
            held: list[pd.DataFrame] = []

            def out(b: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
                number = (b["term"] != b["term"].shift()).cumsum()
                block = (b.groupby(number).cumcount() // BLOCK).rename("block")
                end = len(b) if last else int((b["term"] != b["term"].iloc[-1]).to_numpy().nonzero()[0][-1] + 1 if (b["term"] != b["term"].iloc[-1]).any() else len(b) // BLOCK * BLOCK)
                done = b.iloc[:end].groupby([number.iloc[:end], block.iloc[:end]], sort=False)
                made = done.agg(term=("term", "first"), most=("weight", "max"), least=("weight", "min"), n=("doc", "size"), docs=("doc", list), weights=("weight", list))
                return made.reset_index(drop=True), b.iloc[end:]

            for batch in batches:
                held.append(batch)
                if sum(map(len, held)) >= 10_000:
                    made, rest = out(pd.concat(held, ignore_index=True), False)
                    yield made
                    held = [rest]
            if sum(map(len, held)):
                yield out(pd.concat(held, ignore_index=True), True)[0]

        order = [F.col("term"), F.col("weight").desc(), F.col("doc")]
        ranged = self.flat.repartitionByRange(*order).sortWithinPartitions(*order)
        self.blocks = stored(ranged.mapInPandas(cut, f"term string, most double, least double, n long, docs array<{kind}>, weights array<double>"), "posting-blocks")
        self.terms = stored(self.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("top"), F.count("*").alias("blocks")), "posting-terms")

    def drop(self) -> None:
        drop_stored(self.flat, self.blocks, self.terms)

    def _scores(self, pairs: DataFrame, words: DataFrame) -> DataFrame:
        """query, doc, score: of ``pairs`` (query, doc) over ``words`` (query, term)."""
        each = pairs.join(words.select("query", "term"), "query")
        return each.join(self.flat, ["term", "doc"]).groupBy("query", "doc").agg(F.sum("weight").alias("score"))

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """query, doc, score, rank: the best ``k``, ties (to 9 digits) by doc, stored; and query, blocks, read: blocks of its words, and read.

        ``queries`` has query and w (array of different words).
        """
        words = queries.select("query", F.explode("w").alias("term")).join(self.terms, "term")
        words = stored(words, "posting-words")
        lead = words.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.col("top").desc(), "df", "term"))).where(F.col("nth") <= LEAD)
        first = F.row_number().over(W.partitionBy("term").orderBy(F.col("most").desc(), F.col("least").desc(), F.col("docs")[0]))
        firsts = self.blocks.join(lead.select("term").distinct(), "term", "left_semi").withColumn("nth", first).where(F.col("nth") <= -(-k // BLOCK))
        pairs = lead.select("query", "term").join(firsts, "term").select("query", F.explode("docs").alias("doc")).distinct()
        best = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "doc"))
        reached = self._scores(pairs, words).withColumn("nth", best).where(F.col("nth") == k).select("query", (F.col("score") - SLACK).alias("reach"))
        # the budget goes to the longest lists first
        shares = words.join(reached, "query", "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)))
        spent = F.coalesce(F.sum("top").over(W.partitionBy("query").orderBy(F.col("df").desc(), "term").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        share = F.least(F.col("top"), F.greatest(F.col("reach") - spent, F.lit(0.0)))
        shares = stored(shares.select("query", "term", "reach", "blocks", share.alias("share")), "posting-shares")
        total = F.sum("share").over(W.partitionBy("query"))
        wanted = shares.withColumn("passed", total).join(self.blocks.withColumnRenamed("n", "size"), "term").where(F.col("most") > F.col("share"))
        read = stored(wanted.select("query", "share", "reach", "passed", F.arrays_zip("docs", "weights").alias("p")), "posting-read")
        rows = read.select("query", "share", "reach", "passed", F.inline("p")).where(F.col("weights") > F.col("share"))
        partly = rows.groupBy("query", F.col("docs").alias("doc")).agg(F.sum("weights").alias("known"), F.first("reach").alias("reach"), F.first("passed").alias("passed"))
        partly = stored(partly.where(F.col("known") + F.col("passed") >= F.col("reach")).select("query", "doc", "known"), "posting-candidates")
        lacking = partly.select("query", "doc").join(shares.where("share > 0").select("query", "term", "share"), "query").join(self.flat, ["term", "doc"])
        lacking = lacking.where(F.col("weight") <= F.col("share")).select("query", "doc", F.col("weight").alias("known"))
        scored = partly.unionByName(lacking).groupBy("query", "doc").agg(F.sum("known").alias("score"))
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc"))
        out = stored(scored.withColumn("rank", rank).where(F.col("rank") <= k), "posting-found")
        looked = read.groupBy("query").agg(F.count("*").alias("read"))
        report = stored(words.groupBy("query").agg(F.sum("blocks").alias("blocks")).join(looked, "query", "left").select("query", "blocks", F.coalesce("read", F.lit(0)).alias("read")), "posting-report")
        drop_stored(words, shares, read, partly)
        return out, report


def top_by_postings(queries: DataFrame, docs: DataFrame, k: int, k1: float, b: float, query_id: str, doc_id: str, words: Column, query_words: Column, counted: bool) -> DataFrame:
    """query, doc, score: the ``k`` best documents of each query, stored. Documents with one identifier count as one."""
    asked = queries.select(F.col(query_id).alias("query"), F.array_distinct(query_words).alias("w"))
    terms = stored(asked.select(F.explode("w").alias("term")).distinct(), "asked-terms")
    few = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    sent = F.broadcast(terms) if few[0] <= SENT_TERMS and few[1] <= SENT_BYTES else terms
    table = PostingTable(docs.select(F.col(doc_id).alias("doc"), words.alias("w")), k1, b, counted, sent)
    found, report = table.search(asked, k)
    table.drop()
    drop_stored(report, terms)
    return found.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), "score")
