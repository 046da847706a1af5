"""Operator 13, source divergence audit: how far the sources of a language differ in their words.

1. **Collapse.** Texts are known by (lang, SHA-256); a thin aggregate counts each text's rows per source. Texts of one row
   stay where they are; of the others one copy meets its sources and their multiplicities. No other text is shuffled.
2. **Counting.** Each text is tokenized once. A task adds weighted counts and document frequencies per (lang, source, term)
   and emits them whenever it holds ``HELD`` of them, so memory doesn't grow with the vocabulary.
3. **Kept terms.** Rows of a term meet, at most one per task, source and flush; terms in under ``LEAST`` documents go.
4. **Pairs**, sparsely. With f00 the value of a term that neither source has, the sum over all V terms is
   V f00, plus a correction for the terms of each source as if the other had none (from its histogram of counts: one
   row per source and distinct count), plus one for terms that both have. The latter are summed in the tasks from the
   sources of each term, a batch of terms at a time; only sums per pair of sources leave a task, never a row per term and pair.
5. **Terms** above the language's share, ranked by a window whose limit Spark applies before the shuffle.

All arithmetic is on whole numbers. Shares are divided in three steps of a factor 1000 so that they stay exact with
64 bits up to 9e15 words. Nothing is broadcast by hand and nothing passes the driver; a row holds at most a
language's sources (the result has their square) or a source's distinct counts.

Defined cases: null text, lang and source count as ''; a group without kept terms still has its pairs, 0 where the language
keeps no term; a language of one source has no pairs; repeated rows count each; ``doc_id`` and other columns
aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import drop_stored, mark_hit, stored, table

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
HELD = 500_000  # terms of a task
CELLS = 1_000_000  # numbers of a matrix

#: Bytes of terms, A-Z as a-z; all others end a term. Bytes of a letter beyond ASCII are 128 and more.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def count_terms(rows: DataFrame) -> DataFrame:
    """lang, source, term, count, df: sums over parts of ``rows`` (lang, text, sources: array of (source, n))."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> pd.DataFrame:
            out = {"lang": [], "source": [], "term": [], "count": [], "df": []}
            for (lang, source), (count, df) in held.items():
                out["lang"] += [lang] * len(count)
                out["source"] += [source] * len(count)
                out["term"] += count.keys()
                out["count"] += count.values()
                out["df"] += map(df.__getitem__, count)
            held.clear()
            return pd.DataFrame(out)

        for b in batches:
            size = sum(len(df) for _, df in held.values())
            for lang, text, sources in zip(b["lang"], b["text"], b["sources"], strict=True):
                found = terms(text)
                if not found:
                    continue
                once = set(found)
                weighted = None
                for s in sources:
                    count, df = held.setdefault((lang, s["source"]), (Counter(), Counter()))
                    size -= len(df)
                    if s["n"] == 1:
                        count.update(found)
                        df.update(once)
                    else:
                        weighted = weighted or Counter(found)
                        for t, k in weighted.items():
                            count[t] += k * s["n"]
                            df[t] += s["n"]
                    size += len(df)
                if size > HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return rows.mapInPandas(run, "lang string, source string, term binary, count long, df long").withColumn("term", F.col("term").cast("string"))


def collapsed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lang, text, sources (array of (source, n)): each different text once; the stored lang, digest, source, n; texts of several rows."""
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")}
    rows = docs.select(*[v.alias(c) for c, v in blank.items()]).withColumn("digest", F.unhex(F.sha2("text", 256)))
    uses = stored(rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")), "audit-uses")
    several = stored(uses.groupBy("lang", "digest").agg(F.sum("n").alias("n")).where("n > 1").select("lang", "digest"), "audit-copies")
    key = F.xxhash64("lang", "digest")
    marked = mark_hit(rows, several, key, several.count())
    alone = marked.where("not _hit").select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("n"))).alias("sources"))
    one = marked.where("_hit").groupBy("lang", "digest").agg(F.min("text").alias("text"))
    lists = uses.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    return alone.unionByName(one.join(lists, ["lang", "digest"]).select("lang", "text", "sources")), uses, several


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total), exactly, for counts up to ``total``."""
    out, rest = F.lit(1).cast("long"), count
    for step in (1_000_000, 1_000, 1):
        whole = F.call_function("div", rest * 1000, total)
        out, rest = out + whole * step, rest * 1000 - whole * total
    return out


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, rest = 1, count
    for step in (1_000_000, 1_000, 1):
        whole, rest = np.divmod(rest * 1000, total)
        out = out + whole * step
    return out


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def apart(groups: DataFrame) -> DataFrame:
    """lang, source, item, value: V f00 and the corrections for terms of one of the two, for all pairs of a language.

    ``groups`` has lang, source, total (N + V), v, hist (array of (count, n)), others (array of (source, total)).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, source, total, v, hist, others in b.itertuples(index=False):
                other = [o for o in others if o["source"] != source]
                if not other:
                    continue
                names = [o["source"] for o in other]
                mine, theirs = np.zeros(len(other), np.int64), np.zeros(len(other), np.int64)
                if v:
                    p0, q0 = _share(np.int64(1), np.int64(total)), _share(np.int64(1), np.array([o["total"] for o in other], np.int64))
                    mine += v * _f(p0, q0)
                    hist = [] if hist is None else hist
                    count, n = (np.array([h[k] for h in hist], np.int64) for k in ("count", "n"))
                    for a in range(0, len(count), step := max(1, CELLS // len(other))):
                        p, m = _share(count[a : a + step] + 1, np.int64(total))[:, None], n[a : a + step, None]
                        mine += (m * (_f(p, q0) - _f(p0, q0))).sum(axis=0)
                        theirs += (m * (_f(q0, p) - _f(q0, p0))).sum(axis=0)
                yield pd.DataFrame({"lang": lang, "source": source, "item": names, "value": mine})
                yield pd.DataFrame({"lang": lang, "source": names, "item": source, "value": theirs})

    return groups.select("lang", "source", "total", "v", "hist", "others").mapInPandas(run, "lang string, source string, item string, value long")


def together(entries: DataFrame) -> DataFrame:
    """lang, source, item, value: the corrections for terms of both, summed by pair over parts of the terms.

    ``entries`` has lang, term, source, p, p0 (p of a term that the source lacks).
    """

    def sums(lang: str, names: np.ndarray, at: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[pd.DataFrame]:
        """Of terms with k sources each: rows of ``at`` (numbers in ``names``), p and p0."""
        m, k = p.shape
        wide = max(1, CELLS // k)  # sources compared with all at once
        for a in range(0, m, rows := max(1, CELLS // (k * k))):
            for c in range(0, k, wide):
                s, t = (slice(a, a + rows), slice(c, c + wide), None), (slice(a, a + rows), None)
                value = _f(p[s], p[t]) - _f(p[s], p0[t]) - _f(p0[s], p[t]) + _f(p0[s], p0[t])
                pair = at[s] * len(names) + at[t]
                total = pd.Series(value.reshape(-1)).groupby(pair.reshape(-1), sort=False).sum()
                s, t = np.divmod(total.index.to_numpy(), len(names))
                other = s != t
                total, s, t = total[other], s[other], t[other]
                yield pd.DataFrame({"lang": lang, "source": names[s], "item": names[t], "value": total.to_numpy()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (lang, k), part in b.groupby(["lang", "k"], sort=False):
                at, names = pd.factorize(np.concatenate(part["sources"].to_numpy()))
                p, p0 = (np.concatenate(part[c].to_numpy()).reshape(-1, k) for c in ("p", "p0"))
                yield from sums(lang, names, at.reshape(-1, k), p, p0)

    lists = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("e"))
    lists = lists.select("lang", F.size("e").alias("k"), F.col("e.source").alias("sources"), F.col("e.p").alias("p"), F.col("e.p0").alias("p0")).where("k > 1")
    return lists.mapInPandas(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    texts, uses, several = collapsed(docs)
    # rows of a term come together once: its counts by source and the language's are sums over the same exchange
    counted = count_terms(texts).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))
    kept = counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("count").alias("all"), F.collect_list(F.struct("source", "count")).alias("e")).where(F.col("df") >= least)
    kept = stored(kept.select("lang", "term", "all", F.inline("e")), "audit-terms")
    drop_stored(several)

    langs = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n"))
    langs = stored(langs.select("lang", "v", (F.col("n") + F.col("v")).alias("lang_total")), "audit-langs")
    used = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = uses.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_total"])
    groups = stored(groups.select("lang", "source", (F.col("n") + F.col("v")).alias("total"), "v", "lang_total"), "audit-groups")
    for frame in (uses, langs):
        drop_stored(frame)

    one = F.lit(1).cast("long")
    entries = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "count", "all", "lang_total", share(F.col("count") + 1, F.col("total")).alias("p"), share(one, F.col("total")).alias("p0"))
    hist = kept.groupBy("lang", "source", "count").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("count", "n")).alias("hist"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("others"))
    pairs = apart(groups.join(hist, ["lang", "source"], "left").join(others, "lang")).unionByName(together(entries))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    q = share(F.col("all") + 1, F.col("lang_total"))
    above = entries.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where("p > q")
    above = above.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = above.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    pairs = pairs.withColumn("rank", rank)
    return pairs.unionByName(above).select("lang", "source", "part", "item", "value", "rank")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
df AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN df USING (lang, term) GROUP BY lang, source, term),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
ln AS (SELECT lang, sum(n)::HUGEINT AS total, count(*) AS v FROM lc GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
lp AS (SELECT lc.lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (ln.total + ln.v) AS p FROM lc JOIN ln USING (lang)),
gp AS MATERIALIZED (
  SELECT gn.lang, gn.source, df.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.total + ln.v))::BIGINT AS p
  FROM gn JOIN df USING (lang) JOIN ln USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = df.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT gp.lang, gp.source, 'term', gp.term, ((gp.p - lp.p) * (gp.p - lp.p) // lp.p)::BIGINT
  FROM gp JOIN lp USING (lang, term) WHERE gp.n > 0 AND gp.p > lp.p),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
