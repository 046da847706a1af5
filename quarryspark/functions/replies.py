"""Prompts and the JSON replies of language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SOURCE_TYPES

PLANNER_PROMPT = "Choose sources for the question and rewrite it.\nQuestion: {query}\nFeedback on the last answer: {feedback}\nReply as JSON with sources_to_use and rewritten_query."
SYNTHESIZER_PROMPT = "Answer from the context and cite it by its labels.\nContext:\n{context}\n\nQuestion: {query}"
CRITIC_PROMPT = "Is the answer good or poor for the question? Reply as JSON with quality and feedback.\nQuestion: {query}\nAnswer: {answer}"


def prompt(template: str, **parts: Column) -> Column:
    """The template with each {name} replaced; the parts' own braces are left alone."""
    pieces, rest = [], template
    while rest:
        spots = sorted((rest.find("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest)
        if not spots:
            pieces.append(F.lit(rest))
            break
        at, name = spots[0]
        pieces += [F.lit(rest[:at]), F.coalesce(parts[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def planner_prompt(query: Column, feedback: Column) -> Column:
    return prompt(PLANNER_PROMPT, query=query, feedback=F.coalesce(F.nullif(feedback, F.lit("")), F.lit("none")))


def _parsed(reply: Column, schema: str) -> Column:
    """The reply as a struct, null unless the whole of it is one JSON object."""
    whole = F.regexp_replace(reply, r"^\s+|\s+$", "")
    ok = whole.startswith("{") & whole.endswith("}")
    return F.when(ok, F.from_json(whole, schema, {"allowSingleQuotes": "false"}))


def default_sources(sources: Column) -> Column:
    """Known sources in order, duplicates kept; all of them where none is left."""
    known = F.filter(sources, lambda s: s.isin(*SOURCE_TYPES))
    return F.when(F.coalesce(F.size(known), F.lit(0)) > 0, known).otherwise(F.array(*map(F.lit, SOURCE_TYPES)))


def planner_reply(reply: Column, query: Column) -> tuple[Column, Column]:
    """Sources to use and the query to go on with; all sources and the query as it is if the reply can't be read."""
    p = _parsed(reply, "sources_to_use array<string>, rewritten_query string")
    return default_sources(p["sources_to_use"]), F.coalesce(p["rewritten_query"], query)


def critic_reply(reply: Column) -> tuple[Column, Column]:
    """Is the answer poor, and the feedback if so. What can't be read counts as good."""
    p = _parsed(reply, "quality string, feedback string")
    poor = F.coalesce(p["quality"] == "poor", F.lit(False))
    return poor, F.when(poor, F.coalesce(p["feedback"], F.lit(""))).otherwise(F.lit(""))


def replan(needs_replan: Column, iteration: Column) -> Column:
    return needs_replan & (iteration < 2)
