"""The answering loop: plan, retrieve, synthesise, criticise, at most twice, for a whole set of queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as T
from ..operators.context import context, with_context
from ..operators.retrieve import K, retrieve, retrieved_lists
from ..sources.models import ChatModel, Embedder, completed, context_critic, echo_planner, embedded, first_context_answer, hashing_embedder
from ..sources.scratch import drop_stored, stored

PLAN_TOKENS, ANSWER_TOKENS, CRITIC_TOKENS, MOST_PASSES = 200, 1024, 150, 2


@dataclass
class Models:
    planner: ChatModel = echo_planner
    synthesizer: ChatModel = first_context_answer
    critic: ChatModel = context_critic
    load_embedder: Callable[[], Embedder] = hashing_embedder()


def _pass(state: DataFrame, chunks: DataFrame, models: Models, k: int, last: bool, enforce: bool) -> DataFrame:
    """One pass over ``state`` (query_id, query, sources, source_ids, critic_feedback, iteration)."""
    reply = completed(R.planner_prompt(F.col("query"), F.col("critic_feedback")), models.planner, PLAN_TOKENS)
    planned = state.withColumn("_reply", reply)
    sources, query = R.planner_reply(F.col("_reply"), F.col("query"))
    planned = planned.withColumns({"sources_to_use": sources, "query": query}).drop("_reply")
    planned = planned.withColumn("embedding", embedded(F.col("query"), models.load_embedder))
    planned = stored(planned, "agent-planned")
    lists = retrieved_lists(retrieve(planned, chunks, k, enforce))
    answered = with_context(planned.drop("embedding"), lists)
    prompt = R.prompt(R.SYNTHESIZER_PROMPT, query=F.col("query"), context=F.col("context"))
    answered = answered.withColumn("answer", completed(prompt, models.synthesizer, ANSWER_TOKENS)).withColumn("iteration", F.col("iteration") + 1)
    if last:  # no critic is asked any more
        out = stored(answered.withColumns({"needs_replan": F.lit(False), "critic_feedback": F.lit("")}).drop("context"), "agent-last")
        drop_stored(planned)
        return out.withColumn("context", context(F.col("retrieved_chunks")))
    verdict = answered.withColumn("_reply", completed(R.prompt(R.CRITIC_PROMPT, query=F.col("query"), answer=F.col("answer")), models.critic, CRITIC_TOKENS))
    poor, feedback = R.critic_reply(F.col("_reply"))
    out = stored(verdict.withColumns({"needs_replan": poor, "critic_feedback": feedback}).drop("_reply", "context"), "agent-first")
    drop_stored(planned)
    return out.withColumn("context", context(F.col("retrieved_chunks")))


def answer(queries: DataFrame, chunks: DataFrame, models: Models | None = None, k: int = K, enforce_user_sources: bool = False) -> DataFrame:
    """query_id, original_query, query, sources_to_use, source_ids, retrieved_chunks, context, answer, critic_feedback, needs_replan, iteration.

    ``queries`` has query_id, query, and may have sources and source_ids (arrays). The planner decides which sources
    are searched; with ``enforce_user_sources`` only among those that the user names. Queries whose first answer
    is poor go through a second pass with the rewritten query and the feedback; the others don't. Each pass is stored, so a
    model is asked once a query whatever is lost, and what isn't needed any more is deleted. The result reads both passes; contexts,
    which their chunks give, are stored in none.
    """
    models = models or Models()
    there = set(queries.columns)
    state = queries.select(
        "query_id", F.col("query").alias("original_query"), "query",
        *[(F.col(c) if c in there else F.lit(None)).cast("array<string>").alias(c) for c in ("sources", "source_ids")],
        F.lit("").alias("critic_feedback"), F.lit(0).alias("iteration"),
    )
    first = _pass(state, chunks, models, k, False, enforce_user_sources)
    again = first.where(R.replan(F.col("needs_replan"), F.col("iteration")))
    second = _pass(again.select(*state.columns), chunks, models, k, True, enforce_user_sources)
    return first.where(~R.replan(F.col("needs_replan"), F.col("iteration"))).unionByName(second.select(*first.columns))


def messages(answers: DataFrame, at, turns: DataFrame | None = None) -> DataFrame:
    """Rows of the message table for answered queries: the query as the user wrote it, and the answer."""
    role = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("user").alias("role"), F.col("original_query").alias("content")), F.struct(F.lit(1).alias("n"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    rows = answers.select(F.col("query_id").cast("string").alias("conversation_id"), role.alias("m"))
    return rows.select(T.content_id(F.col("conversation_id"), F.col("m.role"), F.col("m.content")).alias("id"), "conversation_id", "m.role", "m.content", at.alias("created_at"), F.col("m.n").cast("long").alias("turn"))
