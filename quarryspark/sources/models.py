"""Connectors to models: embedders and chat models as Arrow-batched functions, with offline stand-ins.

The stand-ins are deterministic and need no network. They are no match for the models they stand in for; any
function with the same signature takes their place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: texts -> array [texts, dimensions], or None if there is no model
Embedder = Callable[[list[str]], "np.ndarray | None"]
#: prompts, longest answer in tokens -> answers (None counts as empty)
ChatModel = Callable[[list[str], int], "list[str | None]"]


#: Words whose place a worker keeps.
CACHE = 200_000


def hashing_embedder(dimensions: int = 384) -> Callable[[], Embedder]:
    """A loader of an embedder that hashes words to signed dimensions, unit length; blank texts give zeros."""

    class Places(dict):  # of words: twice the dimension, and 1 for a plus
        def __missing__(self, word: str) -> int:
            h = zlib.crc32(word.encode())
            self[word] = h % dimensions * 2 + (h >> 31)
            return self[word]

    def load() -> Embedder:
        known, split = Places(), re.compile(r"\w+").findall

        def embed(texts: list[str]) -> np.ndarray:
            if len(known) > CACHE:
                known.clear()
            words = [split(t.lower()) for t in texts]
            size = np.fromiter(map(len, words), np.int64, len(words))
            at = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
            cell = np.repeat(np.arange(len(texts)), size) * dimensions + (at >> 1)
            out = np.bincount(cell, (at & 1) * 2.0 - 1.0, len(texts) * dimensions).reshape(-1, dimensions).astype(np.float32)
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return embed

    return load


def embedded(text: Column, load: Callable[[], Embedder]) -> Column:
    """Embeddings as array<float>, null where there is no model or no text. The model is loaded once per worker.
    Not repeated or moved by the optimiser: a filter on the embeddings would embed all texts twice."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # noqa: BLE001  no model: no embeddings
            model = None
        for b in batches:
            there = b.notna()
            found = model(b[there].tolist()) if model is not None and there.any() else None
            out = pd.Series([None] * len(b), index=b.index, dtype=object)
            if found is not None:
                out[there] = pd.Series(list(np.asarray(found, np.float32)), index=b.index[there], dtype=object)
            yield out

    return run.asNondeterministic()(text)


def completed(prompt: Column, model: ChatModel, max_tokens: int = 1024) -> Column:
    """Answers of a chat model, the empty text where it gives none. Not repeated or moved by the optimiser."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series([a or "" for a in model([x or "" for x in p], max_tokens)])

    return run.asNondeterministic()(prompt)


def echo_planner(prompts: list[str], _: int) -> list[str]:
    """Keeps the question and all sources."""
    return ["{}" for _p in prompts]


def first_context_answer(prompts: list[str], _: int) -> list[str]:
    """Says the first labelled passage of the context."""
    out = []
    for p in prompts:
        context = p.partition("Context:\n")[2].partition("\n\nQuestion:")[0]
        first = context.split("\n\n---\n\n")[0]
        out.append("I don't know." if context.startswith("No context retrieved.") else first[:500])
    return out


def context_critic(prompts: list[str], _: int) -> list[str]:
    """Poor if the answer says that it does not know."""
    return ['{"quality": "poor", "feedback": "no passage was found"}' if "I don't know." in p else '{"quality": "good", "feedback": ""}' for p in prompts]
