"""What may come before retrieval: hypothetical answers, summaries of long histories, the set of documents kept at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import replies as R
from ..sources.models import ChatModel, completed

HYPOTHESIS_PROMPT = "Write a short passage that answers the question.\nQuestion: {query}"
SUMMARY_PROMPT = "Sum up the conversation.\n{messages}"


def with_hypothesis(queries: DataFrame, model: ChatModel, max_tokens: int = 200) -> DataFrame:
    """``queries`` (query) with ``search_text``: the query and a hypothetical answer, whose embedding is searched for."""
    answer = completed(R.prompt(HYPOTHESIS_PROMPT, query=F.col("query")), model, max_tokens)
    rows = queries.withColumn("_answer", answer)
    return rows.withColumn("search_text", F.when(F.col("_answer") == "", F.col("query")).otherwise(F.concat_ws("\n", "query", "_answer"))).drop("_answer")


def summarised(messages: DataFrame, most: int, recent: int, model: ChatModel, key: str = "conversation_id", max_tokens: int = 300) -> DataFrame:
    """key, summary, history: of conversations of over ``most`` messages the older ones are summed up, ``recent`` stay.

    ``messages`` has key, turn, role and content. Shorter conversations keep all messages and have an empty summary.
    """
    n = F.count("*").over(W.partitionBy(key))
    back = F.row_number().over(W.partitionBy(key).orderBy(F.col("turn").desc()))
    rows = messages.withColumns({"_n": n, "_back": back}).withColumn("_old", (F.col("_n") > most) & (F.col("_back") > recent))
    line = F.struct("turn", F.concat("role", F.lit(": "), "content").alias("line"))
    lists = rows.groupBy(key).agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part, line))), lambda x: x["line"]), "\n").alias(name) for name, part in (("_older", F.col("_old")), ("history", ~F.col("_old")))])
    summary = completed(R.prompt(SUMMARY_PROMPT, messages=F.col("_older")), model, max_tokens)
    lists = lists.withColumn("_summary", summary)
    return lists.select(key, F.when(F.col("_older") == "", "").otherwise(F.col("_summary")).alias("summary"), "history")


def kept_documents(uses: DataFrame, changed: DataFrame, n: int = 50) -> DataFrame:
    """source_id, last_used, position of the ``n`` documents used last; those changed since their last use are out.

    ``uses`` has source_id and used_at, ``changed`` source_id and changed_at. Only ``n`` rows a task are sorted.
    """
    last = uses.groupBy("source_id").agg(F.max("used_at").alias("last_used"))
    stale = changed.groupBy("source_id").agg(F.max("changed_at").alias("_changed"))
    fresh = last.join(stale, "source_id", "left").where("_changed is null or _changed <= last_used").drop("_changed")
    top = fresh.orderBy(F.col("last_used").desc(), "source_id").limit(n)
    return top.withColumn("position", F.row_number().over(W.orderBy(F.col("last_used").desc(), "source_id")))


def first_words(prompts: list[str], tokens: int) -> list[str]:
    """A stand-in for a model that sums up: the first words of what it is given."""
    return [" ".join(p.partition("\n")[2].split()[: max(1, tokens // 50)]) for p in prompts]
