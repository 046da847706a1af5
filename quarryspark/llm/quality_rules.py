"""Operator 4, quality rules: text statistics, two fixed rules, and robust multivariate outliers.

The fixed rules reject texts of fewer than ``MIN_WORDS`` words and texts in which more than a fifth of the
words stand in repeated five-word windows. The method then rejects outliers among the rest: per group of
language and source the minimum-covariance-determinant estimate of location and scatter is fitted to
transformed statistics, and a text whose Mahalanobis distance exceeds a chi-squared quantile goes.

The fit is the concentration step of FastMCD, as grouped aggregates: distances under the current estimate,
the ``H_SHARE`` of rows with the smallest ones, new moments from these. It starts from all rows and, again,
from medians and absolute deviations; per group the start with the smaller determinant wins, and the
consistency factor and one reweighting step follow. Statistics are fixed-point numbers, their sums are exact
longs, and ranks come from counts per distance bucket, so results don't depend on partitions or order.
All of it is DataFrame functions. A group needs no task of its own: every pass over rows ends in a partial
aggregate per (group, bucket), and the estimates join back as one small row per group.

Defined cases: null text has no words (and fails the base rules); null lang or source form groups of their
own; groups under ``MIN_GROUP`` rows are judged by the estimate of their language, languages under it by that of all rows; variances have a floor
(``FLOOR``, used where a group's variance is less), so statistics that don't vary within a group reject nothing small; an empty table gives no rows;
repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE, drop_stored, stored, table

MIN_WORDS, MAX_REPEAT_PERCENT, NGRAM = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: Statistics of the method, the share of rows an estimate is made from, and most concentration steps: a group's end when
#: its log determinant falls by less than SETTLED.
P, H_SHARE, STEPS, MIN_GROUP = 5, 0.75, 20, 30
SETTLED = 0.01
UNIT = 1000  # fixed-point units of a transformed statistic
#: Least standard deviations given the statistics in front, in those units: for statistics that hardly vary in a group.
#: Each is small enough that its statistic alone can exceed the limit: from a centre without any, 7 % of symbols, 23 % of
#: duplicate lines or 15 % of repeated words do, and from a mean word length of 5, one of 1.
FLOOR = (500, 200, 450, 700, 600)
#: Chi-squared quantiles with five degrees of freedom (fixed values): 0.75, 0.975, and 0.999, the rejection limit.
CHI_75, CHI_975, CHI_REJECT = 6.6257, 12.8325, 20.5150
#: P(chi2 with 7 degrees < CHI_75): the consistency factor of a 0.75 subset is 0.75 over it.
CONSISTENT_75, CONSISTENT_975 = 0.75 / 0.5309, 0.975 / 0.9239
ALL = "all"  # the group of all rows; others are JSON
BUCKETS = 24  # distance buckets per unit of log
WAYS = 16  # tasks that a group's rows are dealt to where its estimate isn't broadcast


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("w", F.filter(F.split("t", f"[{SPACE}]+"), lambda x: x != ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    gram = f"transform(sequence(0, size(w) - {NGRAM}), i -> xxhash64({', '.join(f'get(w, i + {k})' for k in range(NGRAM))}))"
    d = d.withColumn("h", F.expr(f"if(size(w) >= {NGRAM}, {gram}, cast(array() as array<bigint>))"))
    d = d.withColumn("twice", F.size(F.array_distinct("h")) < F.size("h"))
    # only texts with a repeated window go on: windows sorted by hash, those equal to a neighbour, in text order
    d = d.withColumn("s", F.expr("if(twice, array_sort(transform(h, (x, i) -> struct(x as x, i as i))), cast(array() as array<struct<x: bigint, i: int>>))"))
    d = d.withColumn("at", F.expr("if(twice, array_sort(filter(transform(s, (e, j) -> if(e.x = get(s, j - 1).x or e.x = get(s, j + 1).x, e.i, -1)), i -> i >= 0)), cast(array() as array<int>))"))
    repeat = F.expr(f"aggregate(at, named_struct('last', -{NGRAM}, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least({NGRAM}, i - a.last)), a -> a.n)")
    kept = F.char_length(F.translate("t", "\t\n\x0b\x0c\r ", ""))
    return d.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        kept.cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def transformed() -> list[Column]:
    """The statistic vector, each part on a scale where texts of one kind spread evenly."""
    share = lambda part, whole: F.log1p(100.0 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    parts = [F.log1p("n_words"), F.log(1.0 + F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.round(UNIT * x).cast("long") for x in parts]


def _join_groups(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """``rows`` with what ``groups`` says of their g, a large group in WAYS parts."""
    way = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(WAYS))
    ways = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WAYS - 1).cast("long")))
    return rows.withColumn("way", way).join(groups.withColumn("way", ways), ["g", "way"], how).drop("way")


def _with_distance(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Rows with d2, by forward substitution one column after another; null where the group has no estimate."""
    out = _join_groups(rows, est, "left")
    for i in range(P):
        rest = F.col(f"v{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"c_{i}_{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"c_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0")))


_SUMS = [f"s{i}" for i in range(P)] + [f"q_{i}_{j}" for i in range(P) for j in range(i + 1)]


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q_{i}_{j}") for i in range(P) for j in range(i + 1)]]


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """g (and start), centre m*, Cholesky factor c_*, log determinant, from n, s*, q_* of each group."""
    e = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    for i in range(P):
        for j in range(i + 1):
            cov = factor * (F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            for k in range(j):
                cov = cov - F.col(f"c_{i}_{k}") * F.col(f"c_{j}_{k}")
            e = e.withColumn(f"c_{i}_{j}", F.sqrt(F.greatest(cov, F.lit(float(FLOOR[i] ** 2)))) if i == j else cov / F.col(f"c_{j}_{j}"))
    det = sum((F.log(f"c_{i}_{i}") for i in range(1, P)), F.log("c_0_0"))
    keys = [c for c in ("g", "start") if c in sums.columns]
    return e.select(*keys, *[f"m{i}" for i in range(P)], *[f"c_{i}_{j}" for i in range(P) for j in range(i + 1)], det.alias("det"))


def _concentrate(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Moments of the ``H_SHARE`` of each group's rows that are nearest (whole buckets of distance), for each start."""
    bucket = F.floor(BUCKETS * F.log1p("d2")).cast("int")
    per = _with_distance(rows, est).where("d2 is not null").groupBy("g", "start", bucket.alias("bucket")).agg(*_moments())
    per = stored(per, "mcd-buckets")  # whole sums: a group has some hundred rows here, whatever the number of tasks
    w = W.partitionBy("g", "start")
    before = F.coalesce(F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({"before": before, "all": F.sum("n").over(w)}).where(F.col("before") < H_SHARE * F.col("all"))
    return per.groupBy("g", "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _SUMS])


def _median_start(rows: DataFrame, least: int) -> DataFrame:
    """An estimate with coordinate-wise medians and absolute deviations, on a grid of 1/20 unit."""
    grid = UNIT // 20

    def medians(values: list[Column], frame: DataFrame) -> DataFrame:
        long = frame.select("g", F.posexplode(F.array(*values)).alias("k", "x")).groupBy("g", "k", F.floor(F.col("x") / grid).alias("b")).agg(F.count("*").alias("n"))
        w = W.partitionBy("g", "k")
        upto = F.sum("n").over(w.orderBy("b").rowsBetween(W.unboundedPreceding, 0))
        long = long.withColumns({"upto": upto, "all": F.sum("n").over(w)}).where(2 * F.col("upto") >= F.col("all"))
        return long.groupBy("g", "k").agg((F.min("b") * grid + grid // 2).alias("x"), F.max("all").alias("all"))

    mid = medians([F.col(f"v{i}") for i in range(P)], rows)
    mid = mid.groupBy("g").agg(F.max("all").alias("n"), *[F.max(F.when(F.col("k") == i, F.col("x"))).cast("double").alias(f"m{i}") for i in range(P)])
    mid = stored(mid, "mcd-medians")
    dev = medians([F.abs(F.col(f"v{i}") - F.col(f"m{i}")) for i in range(P)], _join_groups(rows, mid.drop("n"), "inner"))
    dev = dev.groupBy("g").agg(*[F.max(F.when(F.col("k") == i, F.col("x"))).alias(f"d{i}") for i in range(P)])
    both = mid.where(F.col("n") >= least).join(dev, "g")
    zero = {f"c_{i}_{j}": F.lit(0.0) for i in range(P) for j in range(i)}
    diagonal = {f"c_{i}_{i}": F.greatest(1.4826 * F.col(f"d{i}"), F.lit(float(FLOOR[i]))) for i in range(P)}
    return both.withColumns(zero | diagonal).select("g", *[f"m{i}" for i in range(P)], *[f"c_{i}_{j}" for i in range(P) for j in range(i + 1)], F.lit(0.0).alias("det"))


def robust_estimates(rows: DataFrame, least: int = MIN_GROUP) -> DataFrame:
    """One row per group of ``least`` rows: centre, Cholesky factor and determinant of the reweighted MCD estimate.

    ``rows`` has g (group) and v0..v4 (longs).
    """
    everything = rows.groupBy("g").agg(*_moments()).where(F.col("n") >= least)
    starts = _estimate(everything, 1.0).withColumn("start", F.lit(0)).unionByName(_median_start(rows, least).withColumn("start", F.lit(1)))
    est = stored(starts.withColumns({"det": F.lit(float("inf")), "active": F.lit(True)}), "mcd-start")
    cols = [c for c in est.columns if c not in ("g", "start", "active")]
    for _ in range(STEPS):
        new = _estimate(_concentrate(rows, est.where("active").drop("active")), CONSISTENT_75).select("g", "start", F.struct(*cols).alias("new"))
        better = F.coalesce(F.col("new.det") < F.col("det") - SETTLED, F.lit(False))
        both = est.join(new, ["g", "start"], "left").select("g", "start", *[F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in cols], better.alias("active"))
        old, est = est, stored(both, "mcd-step")
        drop_stored(old)
        if est.where("active").isEmpty():
            break
    est = est.drop("active")
    cols = [c for c in est.columns if c not in ("g", "start", "det")]
    raw = stored(est.groupBy("g").agg(F.min(F.struct("det", *cols)).alias("e")).select("g", "e.*"), "mcd-raw")
    near = _with_distance(rows, raw).where(F.col("d2") <= CHI_975).groupBy("g").agg(*_moments())
    return stored(_estimate(near, CONSISTENT_975), "mcd-estimate")


def _estimates(rows: DataFrame) -> DataFrame:
    """As ``robust_estimates``, for each g of ``rows`` (g, l, v0..v4): small groups get the estimate of their language
    (l), small languages that of all rows."""
    sizes = stored(rows.groupBy("g", "l").agg(F.count("*").alias("n")), "quality-groups")
    own = robust_estimates(rows)
    small = sizes.where(F.col("n") < MIN_GROUP).select("g", "l")
    if small.isEmpty():
        return own
    needed = small.select("l").distinct().join(sizes.groupBy("l").agg(F.sum("n").alias("n")), "l")
    needed = stored(needed.select("l", (F.col("n") < MIN_GROUP).alias("rare")), "quality-languages")
    values = [f"v{i}" for i in range(P)]
    pooled = rows.join(needed.where("not rare"), "l", "left_semi").select(F.col("l").alias("g"), *values)
    if not needed.where("rare").isEmpty():
        pooled = pooled.unionByName(rows.select(F.lit(ALL).alias("g"), *values))
    wider = robust_estimates(pooled, 1).withColumnRenamed("g", "_w")
    small = small.join(needed, "l").withColumn("_w", F.when(F.col("rare"), F.lit(ALL)).otherwise(F.col("l")))
    return own.unionByName(small.join(wider, "_w").select(*own.columns))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The statistics of every document, base_failed, kept and distance2 (null: no row of the group passes the base rules)."""
    stats = text_statistics(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = stats.withColumns({"base_failed": failed, "g": F.to_json(F.struct("lang", "source")), "l": F.to_json(F.struct("lang"))} | {f"v{i}": x for i, x in enumerate(transformed())})
    stats = stored(stats, "quality-statistics")
    rows = stats.where(~F.col("base_failed")).select("g", "l", *[f"v{i}" for i in range(P)])
    scored = _with_distance(stats, _estimates(rows))
    kept = ~F.col("base_failed") & (F.col("d2") <= CHI_REJECT)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance2"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("distance2")
