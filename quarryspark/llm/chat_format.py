"""Operator 11, chat formatting: a template is a black box, rendered for one turn more at a time.

``pieces`` renders successive prefixes of a conversation's turns and compares each output with the one before. What is new at
its end is the turn's piece; an output that doesn't begin with the one before shows that the template rewrites
history: the pieces in front are cut where the outputs part, and the turn is marked. The header and the footer of a turn are what
two probe texts in its place leave equal; the text under the loss mask is what lies between, and only where that is the
escaped text as a whole, so nothing is trained on that the template changed.

Prefixes of a whole conversation would cost the square of its length. A template states its ``memory``, how many
turns back it looks (the first turn may differ, too): prefixes then begin ``memory`` turns before the block of ``BLOCK`` turns at
hand. With ``memory`` None prefixes are whole: right for any template, square in the turns.

A conversation is a stream of rows sorted by turn, from which a task holds one block. Conversations of more than
``LONG`` turns, and a third of all rows may be one, are numbered by a range sort, which deals one conversation to many tasks,
and rendered by (conversation, block) with the context in front. Only their digests, which SHA-256 defines in
order, pass one task: piece by piece, in constant memory.

Defined cases: null text and role are empty; turns in the order of (turn, role, text), null turns first, repeated rows
are turns of their own; null conv_ids are one conversation; roles other than system, user and assistant are kept, escaped like
texts; an empty table gives no conversations but the one that the query adds; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import left_join_groups, may_hit, stored, table
from .sharding import numbered

BLOCK, LONG = 16, 4096
Turn = tuple[str, str]

#: What the template's marks are made of. A text's own get a backslash more behind their first character.
_MARK = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|TURN\]|TEXT\]))")


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\(\\*)(/?(?:s>|INST\]|SYS\]|TURN\]|TEXT\]))", r"\1\2\3", text)


def instruct(turns: list[Turn]) -> str:
    """The template of the query: instructions in brackets, answers closed by an end mark. ``unread`` is its inverse."""
    out = ["<s>"] if turns else []
    for role, text in turns:
        if role == "user":
            out += ("[INST] ", escape(text), " [/INST]")
        elif role == "system":
            out += ("[SYS] ", escape(text), " [/SYS]")
        elif role == "assistant":
            out += (" ", escape(text), " </s>")
        else:
            out += ("[TURN] ", escape(role), " [TEXT] ", escape(text), " [/TURN]")
    return "".join(out)


_FORMS = (("user", "[INST] ", " [/INST]"), ("system", "[SYS] ", " [/SYS]"), ("assistant", " ", " </s>"))


def unread(piece: str) -> Turn:
    """Role and text of a turn's piece of ``instruct``."""
    piece = piece.removeprefix("<s>")
    for role, head, foot in _FORMS:
        if piece.startswith(head):
            return role, unescape(piece[len(head) : -len(foot)])
    role, _, text = piece[len("[TURN] ") : -len(" [/TURN]")].partition(" [TEXT] ")
    return unescape(role), unescape(text)


@dataclass(frozen=True)
class Template:
    render: Callable[[list[Turn]], str]  # of turns (role, text); any function
    escape: Callable[[str], str]  # how it writes a text
    unescape: Callable[[str], str]
    unread: Callable[[str], Turn]  # role and text of a turn's piece
    memory: int | None = None  # turns that it looks back, besides whether a turn is the first; None: all


INSTRUCT = Template(instruct, escape, unescape, unread, memory=1)


@dataclass
class Piece:
    text: str  # what the turn adds to the output
    loss: tuple[int, int] | None  # stretch of the piece that is the turn's text; None: not found as it is
    rewrites: bool  # the template changed what it wrote before
    cut: int = 0  # characters at the end of the earlier output that it took back


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def probed(template: Template, before: list[Turn], role: str) -> tuple[str, str] | None:
    """What stands in front of the text of a turn of ``role`` behind ``before``, and behind it: what two texts in its place leave equal."""
    base, one, two = (template.render([*before, *t]) for t in ([], [(role, "0")], [(role, "1")]))
    head = common(one, two)
    foot = common(one[head:][::-1], two[head:][::-1])
    if one[head : len(one) - foot] != template.escape("0") or two[head : len(two) - foot] != template.escape("1"):
        return None
    return one[common(base, one) if before else 0 : head], one[len(one) - foot :]


class Renderer:
    """Pieces of a conversation, turn by turn. ``context``: turns already rendered elsewhere, in front of the first."""

    def __init__(self, template: Template, context: list[Turn] = ()):
        self.template, self.turns = template, list(context)
        self.last = template.render(self.turns)
        self.form = lru_cache(maxsize=256)(lambda before, role: probed(template, list(before), role))
        self.block = 0

    def add(self, role: str, text: str) -> Piece:
        t, memory = self.template, self.template.memory
        if memory is not None and self.block >= BLOCK:  # prefixes begin anew, with what the template looks back to
            self.turns = self.turns[len(self.turns) - max(1, memory) :]
            self.last, self.block = t.render(self.turns), 0
        before, last = self.turns, self.last
        self.turns, self.block = [*before, (role, text)], self.block + 1
        self.last = out = t.render(self.turns)
        same = common(last, out) if before else 0  # what stands in front of the first turn is in its piece
        # headers depend on roles; where one depends on texts, what follows finds no loss
        near = tuple((r, "") for r, _ in (before if memory is None else before[-max(1, memory) :]))
        form, written, loss = self.form(near, role), t.escape(text), None
        if form:
            start = len(out) - len(form[1]) - len(written)  # counted from the end: what stands before may have been rewritten
            if start >= same and out[start:] == written + form[1] and out[:start].endswith(form[0]):
                loss = (start - same, start - same + len(written))
        cut = len(last) - same if before else 0
        return Piece(out[same:], loss, cut > 0, cut)


#: Columns of a turn's piece. ``cut``: characters of earlier pieces that it takes back; loss stretches are those of all roles.
PIECES = "key string, conv_id long, position long, role string, piece string, loss_start int, loss_end int, rewrites boolean, cut int"


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def pieces(conversations: DataFrame, template: Template = INSTRUCT, long: int = LONG) -> DataFrame:
    """One row per turn (PIECES), sorted by position within the partitions that hold a conversation.

    ``conversations`` has conv_id, turn, role, text; of each conversation all pieces are in one partition.
    """
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(_key(conv).alias("key"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), *blank)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by (key, block, position); rows of ``context`` stand in front and give no piece."""
        now, state, context, position = None, None, [], 0
        for b in batches:
            out = []
            for key, conv_id, role, text, block, place, before in b[["key", "conv_id", "role", "text", "block", "place", "context"]].itertuples(index=False):
                if (key, block) != now:
                    now, state, context, position = (key, block), None, [], place
                if before:
                    context.append((role, text))
                    continue
                if state is None:
                    state, position = Renderer(template, context), place
                p = state.add(role, text)
                out.append((key, conv_id, position, role, p.text, *(p.loss or (None, None)), p.rewrites, p.cut))
                position += 1
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield frame.astype({"conv_id": "Int64", "loss_start": "Int32", "loss_end": "Int32"})

    order = ["turn", "role", "text"]
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("turns")).where(F.col("turns") > long), "chat-long")
    n_long = sizes.count() if template.memory is not None else 0
    if not n_long:
        short, many = rows, None
    else:
        hot = may_hit(rows, sizes, F.xxhash64("key"), n_long)
        many = left_join_groups(hot.withColumn("id", F.encode("key", "UTF-8")), sizes.select(F.encode("key", "UTF-8").alias("id"), "turns"), "id", "turns", rows.count()).where("turns is not null").drop("id", "turns")
        short = rows.join(F.broadcast(sizes.select("key")), "key", "left_anti") if n_long <= 10_000 else rows.join(sizes.select("key"), "key", "left_anti")
    plain = {"block": F.lit(0).cast("long"), "place": F.lit(0).cast("long"), "context": F.lit(False)}
    found = short.repartition("key").sortWithinPartitions("key", *order).withColumns(plain).mapInPandas(run, PIECES)
    if many is None:
        return found
    placed, _ = numbered(many, ["key", *order])
    first = placed.groupBy("key").agg(F.min("row_number").alias("first"), F.count("*").alias("turns")).select(F.encode("key", "UTF-8").alias("id"), "first", "turns")
    placed = left_join_groups(placed.withColumn("id", F.encode("key", "UTF-8")), first, "id", "turns", rows.count())
    placed = placed.withColumn("place", F.col("row_number") - F.col("first"))
    back = max(1, template.memory)
    own = placed.withColumns({"block": F.floor(F.col("place") / long).cast("long"), "context": F.lit(False)})
    ahead = own.where((F.col("place") % long >= long - back) & (F.col("place") < F.col("turns") - 1)).withColumns({"block": F.col("block") + 1, "context": F.lit(True)})
    both = own.unionByName(ahead).repartition("key", "block").sortWithinPartitions("key", "block", "place")
    blocks = both.mapInPandas(run, PIECES).repartition("key").sortWithinPartitions("key", "position")
    return found.unionByName(blocks)


def formatted(conversations: DataFrame, template: Template = INSTRUCT, long: int = LONG) -> DataFrame:
    """conv_id, text, loss (array of [start, end) under the loss mask), rewrites: whole outputs, for templates of any kind.

    One row holds one conversation's output; ``pieces`` is the form without that bound. Stretches that were taken back are gone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, text, loss, rewrites = None, [], [], False

        def row() -> pd.DataFrame:
            return pd.DataFrame({"conv_id": pd.array([now[1]], "Int64"), "text": ["".join(text)], "loss": [loss], "rewrites": [rewrites]})

        size = 0
        for b in batches:
            for p in b.itertuples(index=False):
                if now is None or p.key != now[0]:
                    if now is not None:
                        yield row()
                    now, text, loss, rewrites, size = (p.key, None if pd.isna(p.conv_id) else int(p.conv_id)), [], [], False, 0
                if p.rewrites:
                    size -= p.cut
                    text, rewrites = ["".join(text)[:size]], True
                    loss = [s for s in loss if s[1] <= size]
                if p.role == "assistant" and not pd.isna(p.loss_start):
                    loss.append([size + int(p.loss_start), size + int(p.loss_end)])
                text.append(p.piece)
                size += len(p.piece)
        if now is not None:
            yield row()

    return pieces(conversations, template, long).mapInPandas(run, "conv_id long, text string, loss array<array<long>>, rewrites boolean")


def digests(conversations: DataFrame, template: Template = INSTRUCT, long: int = LONG) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites: all read back from the pieces.

    Where the template rewrites history, pieces aren't what stands in the output (``formatted`` has it): digests are null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, turns, chars, loss, size, rewrites = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]

        def row() -> tuple:
            read = (None, None, None) if rewrites else (turns.hexdigest(), chars, loss.hexdigest())
            return now[1], n, *read, size, rewrites

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64", "loss_chars": "Int64"})

        for b in batches:
            out = []
            for key, conv_id, piece, start, end, again, cut in b[["key", "conv_id", "piece", "loss_start", "loss_end", "rewrites", "cut"]].itertuples(index=False):
                if now is None or key != now[0]:
                    if now is not None:
                        out.append(row())
                    now, n, turns, chars, loss, size, rewrites = (key, conv_id), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False
                role, text = template.unread(piece)
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
                if role == "assistant" and not pd.isna(start):
                    under = template.unescape(piece[int(start) : int(end)])
                    chars += len(under)
                    loss.update(under.encode())
                size += len(piece) - cut
                rewrites |= bool(again)
            yield frame(out)
        if now is not None:
            yield frame([row()])

    return pieces(conversations, template, long).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return digests(rows.unionByName(own)).drop("rewrites")


OP11_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
m AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(s>|(INST|SYS|TURN|TEXT)\])')) AS size,
    CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 6
      ELSE 7 + length(role) + len(regexp_extract_all(role, '[<\[]\\*/?(s>|(INST|SYS|TURN|TEXT)\])')) + 8 + 8 END AS marks
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(size + marks))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
