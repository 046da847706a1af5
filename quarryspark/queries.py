"""Queries over the given tables, one or more per operator, and the SQL that gives the same rows.

The tables stand in for the store: ``documents`` for documents, their ``source`` for source or folder, ``pages`` for
web pages, ``embeddings`` (label: collection) for vectors, ``conversations`` for messages, ``events`` for timed
segments, ``labels`` for verdicts, ``benchmark`` for facts. Searches take every row whose id is divisible by 100 as
a query, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .chunk_sql import chunks_sql
from .functions import replies as R
from .functions import text as T
from .operators import catalog, chunking, context, conversations, evaluation, grams, ingest, pivots, postings, ranking, retrieve
from .plans import agent
from .sources import files, sse
from .sources.scratch import drop_stored, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Small tables of one file are dealt out to all cores before work that costs much per row; others are as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


# --- vectors ---------------------------------------------------------------------------------------------------

_VECTORS = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_distance(q.e, v.e), 6) AS distance, list_cosine_distance(q.e, v.e) AS exact
      FROM v q, v WHERE q.vec_id % 100 = 0)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"""WITH {_VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY exact, vec_id) AS rank FROM d)
SELECT query_id, label, vec_id, distance, rank FROM r WHERE rank <= 5""")
def knn_top5(spark, sf_dir):
    """The five nearest vectors of every collection."""
    e, q = _vectors(spark, sf_dir)
    found = retrieve.nearest(e, q, 5, "vec_id", "label")
    return found.select("query_id", "label", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(SQL["knn_top5"])
def knn_by_pivots(spark, sf_dir):
    """The same for queries of any number: dealt out, and led to the cells of the nearest pivots."""
    e, q = _vectors(spark, sf_dir)
    found = pivots.nearest_by_pivots(e, q, 5, "vec_id", "label", "query_id")
    return found.select("query_id", "label", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact, vec_id) AS rank FROM d WHERE label IN (1, 3, 5))
SELECT query_id, vec_id, label, distance, rank FROM r WHERE rank <= 5""")
def knn_filtered(spark, sf_dir):
    """Nearest vectors behind a metadata filter, over all collections."""
    e, q = _vectors(spark, sf_dir)
    kept = e.where(F.col("label").isin(1, 3, 5)).withColumn("all", F.lit(0))
    found = retrieve.nearest(kept, q, 5, "vec_id", "all").join(kept.select("vec_id", "label"), "vec_id")
    return found.select("query_id", "vec_id", "label", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY exact, vec_id) AS rank FROM d WHERE label IN (2, 0, 1)),
t AS (SELECT *, CASE label WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS source_pos, 'text ' || (vec_id % 50)::VARCHAR AS text FROM r WHERE rank <= 5),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY source_pos, rank) AS first FROM t)
SELECT query_id, source_pos, rank, text, vec_id, distance FROM u WHERE first = 1""")
def knn_union_dedup(spark, sf_dir):
    """Five of each of three collections in a given order; of equal texts the first stays."""
    e, q = _vectors(spark, sf_dir)
    found = retrieve.nearest(e.where(F.col("label").isin(2, 0, 1)), q, 5, "vec_id", "label")
    found = found.withColumns({"source_pos": F.when(F.col("label") == 2, 0).when(F.col("label") == 0, 1).otherwise(2), "text": F.concat(F.lit("text "), (F.col("vec_id") % 50).cast("string"))})
    kept = retrieve.first_of_equal(found, ["query_id", "text"], ["source_pos", "rank"])
    return kept.select("query_id", "source_pos", F.col("rank").cast("long").alias("rank"), "text", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_VECTORS},
q AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 100 = 0),
r AS (SELECT d.query_id, d.label = q.label AS same, row_number() OVER (PARTITION BY d.query_id ORDER BY exact, vec_id) AS rank FROM d JOIN q USING (query_id) WHERE vec_id <> d.query_id),
f AS (SELECT q.query_id, min(CASE WHEN same AND rank <= 5 THEN rank END) AS rank FROM q LEFT JOIN r USING (query_id) GROUP BY 1)
SELECT count(*) AS queries, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS hit_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_3 FROM f""")
def mrr_hit(spark, sf_dir):
    """Mean reciprocal rank and hits of the first of five neighbours with the query's own label."""
    e, q = _vectors(spark, sf_dir)
    found = retrieve.nearest(e.withColumn("all", F.lit(0)), q, 6, "vec_id", "all").where("vec_id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))).where("rank <= 5")
    own = e.select("vec_id", "label")
    hit = ranked.join(own, "vec_id").join(own.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").where("label = wanted")
    ranks = q.select("query_id").join(hit.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")
    return evaluation.quality(ranks).select("queries", F.round("mrr", 6).alias("mrr"), "hit_at_1", F.round("hit_at_3", 6).alias("hit_at_3"))


@query(f"""WITH {_VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact, vec_id) AS rank FROM d WHERE vec_id % 100 <> 0)
SELECT q.vec_id AS query_id, CASE WHEN 1 - exact >= 0.2 THEN r.vec_id END AS entry_id, CASE WHEN 1 - exact >= 0.2 THEN round(1 - exact, 6) END AS similarity
FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN (SELECT * FROM r WHERE rank = 1) r ON r.query_id = q.vec_id""")
def semantic_cache(spark, sf_dir):
    """The nearest cached entry if its similarity reaches a threshold."""
    e, q = _vectors(spark, sf_dir)
    entries = e.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("entry_id"), "embedding", F.lit(0).alias("scope"))
    hits = ranking.cache_lookup(q.withColumn("scope", F.lit(0)), entries, 0.2)
    return hits.select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"))


# --- catalogue, folders, conversations ---------------------------------------------------------------------------


def _document_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))  # in the order of chunks; nothing needs the numbers themselves
    none = F.lit(None).cast("string")
    return d.select(F.col("source").alias("source_id"), F.lit("pdf").alias("source_type"), n.alias("chunk_index"), F.concat("source", F.lit(".txt")).alias("filename"), none.alias("title"), none.alias("url"), F.lit(None).cast("timestamp").alias("event_at"), F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("chunk_id"))


@query("""SELECT source AS source_id, 'pdf' AS source_type, source || '.txt' AS filename, NULL::VARCHAR AS title, source || '.txt' AS label, count(*) AS chunks FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY 1""")
def sources_catalog(spark, sf_dir):
    """One row per source, from its first chunk."""
    rows = catalog.labelled_sources(catalog.list_sources(_document_chunks(spark, sf_dir)))
    return rows.select("source_id", "source_type", "filename", "title", "label", "chunks")


@query("""SELECT source_id, first_doc, lang FROM (SELECT source AS source_id, doc_id AS first_doc, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def first_of_source(spark, sf_dir):
    """Distinct by key, the first row staying."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("source_id")).agg(F.min_by(F.struct("doc_id", "lang"), "doc_id").alias("m")).select("source_id", F.col("m.doc_id").alias("first_doc"), "m.lang")


@query("""SELECT n_name AS name, coalesce(n, 0) AS conversation_count FROM nation LEFT JOIN
(SELECT c_nationkey, count(c_custkey) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) ON c_nationkey = n_nationkey""")
def folder_counts(spark, sf_dir):
    """All folders with the number of what is in them; null folders count nowhere."""
    folders = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit(0).alias("created_at"))
    convs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")).alias("folder_id"))
    return conversations.folder_counts(folders, convs).select("name", F.col("conversation_count").cast("long").alias("conversation_count"))


def _messages(spark, sf_dir):
    m = table(spark, sf_dir, "conversations")
    return m.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), F.lit(0).alias("created_at"), "turn")


@query("""SELECT conv_id, count(turn) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY 1""")
def conversation_detail(spark, sf_dir):
    """Each conversation with its messages in order."""
    m = _messages(spark, sf_dir)
    heads = m.select(F.col("conversation_id").alias("id")).distinct()
    rows = conversations.detail(heads, m)
    line = F.transform("messages", lambda x: F.concat(x["role"], F.lit(": "), x["content"]))
    return rows.select(F.col("id").alias("conv_id"), F.size("messages").cast("long").alias("n"), F.array_join(line, "\n").alias("messages"))


_HISTORY = """SELECT conv_id, string_agg(text, ' | ' ORDER BY turn) AS history FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn {}) AS n FROM conversations) WHERE n <= 3 GROUP BY 1"""


def _history(spark, sf_dir, newest):
    rows = conversations.history(_messages(spark, sf_dir), 3, newest)
    return rows.groupBy(F.col("conversation_id").alias("conv_id")).agg(chunking.ordered_concat("turn", "content", " | ").alias("history"))


@query(_HISTORY.format(""))
def history_oldest(spark, sf_dir):
    """The oldest three messages of each conversation."""
    return _history(spark, sf_dir, False)


@query(_HISTORY.format("DESC"))
def history_newest(spark, sf_dir):
    return _history(spark, sf_dir, True)


@query("""SELECT conv_id, left(arg_min(text, turn), 100) AS title FROM conversations WHERE role = 'user' GROUP BY 1""")
def conversation_titles(spark, sf_dir):
    """The first hundred characters of the first question."""
    return conversations.titles(_messages(spark, sf_dir)).select(F.col("conversation_id").alias("conv_id"), "title")


@query("""SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents WHERE source <> 'src3' GROUP BY 1""")
def delete_source(spark, sf_dir):
    """What is left without one source."""
    kept, _ = catalog.delete_source(table(spark, sf_dir, "documents").withColumn("source_id", F.col("source")).withColumn("chunk_id", F.col("doc_id")), "src3")
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey = 7 THEN NULL ELSE c_nationkey::VARCHAR END AS folder_id FROM customer""")
def delete_folder(spark, sf_dir):
    """A folder goes, what was in it stays in none."""
    folders = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    convs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("folder_id"))
    _, left, _ = conversations.delete_folder(folders, convs, "7")
    return left


# --- text and pages ------------------------------------------------------------------------------------------------


@query("""SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 'is')) AS title FROM pages""")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.page_title(F.col("html"), F.col("url")).alias("title"))


@query("""SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS domain FROM pages""")
def page_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.net_location(F.col("url")).alias("domain"))


@query()
def page_chunks(spark, sf_dir):
    """Pages to chunks of the chunk table: text, title, domain, splitter, embedder."""
    p = spread(table(spark, sf_dir, "pages")).select(T.content_id(F.col("url"), F.col("page_id")).alias("source_id"), "url", "html")
    return ingest.pages(p, at=F.lit("2024-01-01").cast("timestamp")).select("chunk_id", "source_id", "chunk_index", "text", "title", "domain", F.size("embedding").alias("dimensions"))


@query(chunks_sql("SELECT doc_id AS id, text FROM documents", chunking.PDF_SEPARATORS) + " SELECT id AS source_id, n::INTEGER AS chunk_index, char_start, text FROM chunks")
def text_chunks(spark, sf_dir):
    """Documents to chunks of at most 1500 characters that overlap by at most 200."""
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("source_id"), F.lit(0).alias("seg_idx"), "text")
    return chunking.chunk_documents(d).select("source_id", "chunk_index", "char_start", "text")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, s, event_type, s AS anchor, 0 AS chunk_index FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, e.s, e.event_type, CASE WHEN e.s - w.anchor >= 3600 THEN e.s ELSE w.anchor END, w.chunk_index + CASE WHEN e.s - w.anchor >= 3600 THEN 1 ELSE 0 END
      FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, chunk_index, string_agg(event_type, ' ' ORDER BY n) AS text, round_even(min(anchor), 0)::BIGINT AS timestamp_start, round_even(max(s), 0)::BIGINT AS timestamp_end FROM w GROUP BY 1, 2""")
def time_chunks(spark, sf_dir):
    """Greedy windows of an hour over the events of each user."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("text"), seconds.alias("start"), F.lit(0.0).alias("duration"))
    return chunking.timed_windows(e, ["user_id"], 3600.0, ["ts", "event_id"])


@query("""WITH m AS (SELECT *, sum((role = 'user')::INT) OVER w AS seg_idx, last_value(CASE WHEN role = 'user' THEN trim(text) END IGNORE NULLS) OVER w AS heading FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, seg_idx::BIGINT AS seg_idx, heading AS section_heading, string_agg(trim(text), chr(10) ORDER BY turn) AS text FROM m WHERE role <> 'user' AND trim(text) <> '' GROUP BY 1, 2, 3""")
def heading_carry(spark, sf_dir):
    """Paragraphs under the heading in front of them; questions stand in for headings."""
    p = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), (F.col("role") == "user").alias("is_heading"), "text")
    return chunking.sections(p, "conv_id").drop("page_number")


@query("""WITH r AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, sum(CASE WHEN before IS NOT NULL AND before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::INT AS run FROM r""")
def role_runs(spark, sf_dir):
    """Runs of neighbouring messages of one role."""
    return chunking.consecutive_runs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "run")


@query("""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
f AS (SELECT conv_id, turn, unnest(list_concat(list_transform(w, lambda x: 'data: ' || x || ' ' || chr(10) || chr(10)), ['data: [DONE]' || chr(10) || chr(10)])) AS frame,
      generate_subscripts(list_concat(w, ['']), 1) - 1 AS pos FROM t)
SELECT conv_id, turn, pos::INT AS pos, frame FROM f""")
def tokens_sse(spark, sf_dir):
    """Answers as server-sent events, a word each."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    return sse.frames(c, "k", "text").select("k.conv_id", "k.turn", "pos", "frame")


@query("""SELECT doc_id, '[PDF — ' || source || ' p.' || n_chars || ']' AS label, source || ' p.' || n_chars AS cited FROM documents""")
def citations(spark, sf_dir):
    """Citation labels, and what a reader makes of them in a text."""
    label = T.citation_label(F.lit("pdf"), F.col("source"), F.col("n_chars"), F.lit(None), F.lit(None), F.lit(None))
    d = table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))
    return d.withColumn("cited", F.array_join(T.citations(F.concat(F.lit("As "), "label", F.lit(" says."))), ";"))


@query("""SELECT conv_id, coalesce(nullif(string_agg('[Web — ' || conv_id || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn), ''), 'No context retrieved.') AS context FROM conversations GROUP BY 1""")
def context_build(spark, sf_dir):
    """Labelled passages in order, as one context."""
    null = F.lit(None).cast("string")
    chunk = F.struct("turn", F.lit("web").alias("source_type"), null.alias("filename"), F.lit(None).cast("int").alias("page_number"), null.alias("title"), F.lit(None).cast("long").alias("timestamp_start"), F.col("conv_id").cast("string").alias("url"), "text")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(chunk)).alias("c"))
    return rows.select("conv_id", context.context(F.col("c")).alias("context"))


@query("""SELECT doc_id, quality = 0 AS needs_replan, CASE WHEN quality = 0 THEN 'toxic ' || toxic ELSE '' END AS critic_feedback, 1 AS iteration FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def critic_gate(spark, sf_dir):
    """Verdicts of the critic from its JSON replies."""
    reply = F.to_json(F.struct(F.when(F.col("quality") == 0, "poor").otherwise("good").alias("quality"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("feedback")))
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").withColumn("reply", reply)
    poor, feedback = R.critic_reply(F.col("reply"))
    return rows.select("doc_id", R.replan(poor, F.lit(1)).alias("needs_replan"), feedback.alias("critic_feedback"), F.lit(1).alias("iteration"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'web,web' WHEN 'view' THEN 'pdf,youtube,web' ELSE 'youtube' END AS sources, CASE WHEN event_type = 'view' THEN 'user ' || user_id ELSE 'rewritten ' || event_type END AS query FROM events""")
def planner_replies(spark, sf_dir):
    """Plans from JSON replies: unknown sources dropped, duplicates kept, broken replies replaced."""
    kind = F.col("event_type")
    good = lambda s: F.concat(F.lit('{"sources_to_use": ' + s + ', "rewritten_query": "rewritten '), kind, F.lit('"}'))
    reply = F.when(kind == "click", good('["web", "database", "web"]')).when(kind == "view", F.lit("not {valid} json")).otherwise(good('["youtube"]'))
    sources, rewritten = R.planner_reply(F.col("reply"), F.concat(F.lit("user "), F.col("user_id").cast("string")))
    rows = table(spark, sf_dir, "events").withColumn("reply", reply)
    return rows.select("event_id", F.array_join(sources, ",").alias("sources"), rewritten.alias("query"))


@query("""SELECT doc_id, sha256(text) AS token_hash FROM documents""")
def token_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sha256_hex(F.col("text")).alias("token_hash"))


# --- evaluation and ranking ------------------------------------------------------------------------------------------


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    rows = evaluation.latency(table(spark, sf_dir, "events"), "value", ["event_type"])
    return rows.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query(SQL["latency_percentiles"])
def latency_by_selection(spark, sf_dir):
    """The same for groups of any size: counts per value range, narrowed down to the wanted ranks."""
    rows = evaluation.latency(table(spark, sf_dir, "events"), "value", ["event_type"], held=0)
    return rows.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def fact_containment(spark, sf_dir):
    """All documents that contain a fact: one automaton reads every text once."""
    facts = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "fact")
    return evaluation.containing(spread(table(spark, sf_dir, "documents")), facts, "doc_id", "item_id", ignore_case=False)


@query(SQL["fact_containment"])
def facts_by_grams(spark, sf_dir):
    """The same for facts of any number: sought by their rarest grams."""
    facts = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "fact")
    return grams.containing_by_grams(spread(table(spark, sf_dir, "documents")), facts, "doc_id", "item_id", ignore_case=False)


_BM25 = """
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
b AS (SELECT q.query_id, tf.doc_id, sum(ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * tf.len / s.avg_len))) AS score
      FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b)"""


def _bm25(spark, sf_dir, k):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return ranking.bm25(q, spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k, doc_id="doc_id")


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    """The five best documents of every fact by BM25."""
    return _bm25(spark, sf_dir, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(SQL["bm25_topk"])
def bm25_by_postings(spark, sf_dir):
    """The same for queries of any number: a posting table whose blocks are passed over by their greatest impact."""
    words = T.words(F.lower(F.col("w")))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("w"))
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("w")))
    found = postings.top_by_postings(q, d, 5, ranking.K1, ranking.B, "query_id", "doc_id", words, words, True)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), rank.cast("long").alias("rank"))


@query(f"""WITH {_BM25},
o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score_terms DESC, doc_id) AS rank FROM
      (SELECT q.query_id, tf.doc_id, count(*) AS score_terms FROM tf JOIN q USING (term) GROUP BY 1, 2)),
u AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 15 UNION ALL SELECT query_id, doc_id, rank FROM o WHERE rank <= 15) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM u)
SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, rank FROM r WHERE rank <= 5""")
def rrf(spark, sf_dir):
    """BM25 and the count of shared words, fused by reciprocal ranks."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ranking.word_counts(q, d, doc_id="doc_id")
    rankings = [ranking.bm25(q, d, 15, doc_id="doc_id", counts=counts), ranking.shared_words(q, d, 15, doc_id="doc_id", counts=counts)]
    out = ranking.fused(rankings, 5, doc_id="doc_id")
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    """Tumbling windows of an hour; the same expression runs on streams."""
    from .streaming.ingest import event_windows as windows

    return windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


# --- the whole loop ----------------------------------------------------------------------------------------------------


@query()
def agent_answers(spark, sf_dir):
    """Every question of a user, answered from the chunks of all pages and documents."""
    p = spread(table(spark, sf_dir, "pages")).select(T.content_id(F.col("url"), F.col("page_id")).alias("source_id"), "url", "html")
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("source_id"), F.lit(0).alias("seg_idx"), "text", F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("section_heading"), F.col("source").alias("filename"))
    at = F.lit("2024-01-01").cast("timestamp")
    chunks = stored(ingest.pages(p, at=at).unionByName(ingest.documents(d, at=at)), "chunks")
    m = table(spark, sf_dir, "conversations").where("role = 'user'")
    q = m.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    out = agent.answer(q, chunks)
    drop_stored(chunks)
    return out.select("query_id", "query", F.array_join("sources_to_use", ",").alias("sources"), F.size("retrieved_chunks").alias("n_chunks"), "answer", "needs_replan", "iteration")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::DOUBLE AS sum_qty, round(avg(l_discount), 6) AS avg_discount FROM lineitem GROUP BY 1, 2""")
def line_summary(spark, sf_dir):
    """Grouped counts, sums and means."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return d.agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(evaluation.mean(F.col("l_discount")), 6).alias("avg_discount"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def customers_without_orders(spark, sf_dir):
    """Existence test: rows with no partner."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_top5(spark, sf_dir)


from . import table_queries  # noqa: E402  registers its queries

__all__ = ["QUERIES", "SQL", "entry", "files", "table_queries"]
