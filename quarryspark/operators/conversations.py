"""Conversations, messages and folders. Changes are new frames: (frame, ...) in, frame' out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..schemas import CONVERSATIONS, FOLDERS, MESSAGES


def list_conversations(conversations: DataFrame) -> DataFrame:
    """Newest first, of all users."""
    return conversations.select("id", "title", "folder_id", "created_at").orderBy(F.col("created_at").desc(), "id")


def detail(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with its messages in order, an empty list where it has none."""
    item = F.struct("created_at", "turn", "id", "role", "content")
    lists = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(item)).alias("messages"))
    rows = conversations.join(lists, conversations["id"] == lists["conversation_id"], "left").drop("conversation_id")
    return rows.withColumn("messages", F.coalesce("messages", F.array().cast(lists.schema["messages"].dataType)))


def history(messages: DataFrame, n: int = 10, newest: bool = False, key: str = "conversation_id") -> DataFrame:
    """Per conversation ``n`` messages, the oldest ones, or the newest, in the order of time."""
    w = W.partitionBy(key)
    order = [F.col("created_at").desc(), F.col("turn").desc()] if newest else [F.col("created_at"), F.col("turn")]
    return messages.withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def owned(conversations: DataFrame, conversation_id: str, user_id: str) -> tuple[DataFrame, int]:
    """The conversation if it is the user's, else nothing and 404."""
    found = conversations.where((F.col("id") == conversation_id) & (F.col("user_id") == user_id))
    return found, 404 if found.isEmpty() else 200


def folder_counts(folders: DataFrame, conversations: DataFrame) -> DataFrame:
    """All folders, oldest first, with the number of their conversations."""
    n = conversations.where(F.col("folder_id").isNotNull()).groupBy("folder_id").agg(F.count("id").alias("n"))
    rows = folders.join(n, folders["id"] == n["folder_id"], "left")
    return rows.select("id", "name", "created_at", F.coalesce("n", F.lit(0)).alias("conversation_count")).orderBy("created_at", "id")


def in_folder(conversations: DataFrame, folder_id: str | None) -> DataFrame:
    return conversations.where(F.col("folder_id").isNull() if folder_id is None else F.col("folder_id") == folder_id)


def _with(df: DataFrame, schema: str, row: tuple) -> DataFrame:
    return df.unionByName(df.sparkSession.createDataFrame([row], schema), allowMissingColumns=True)


def create_folder(folders: DataFrame, folder_id: str, name: str, at) -> tuple[DataFrame, dict]:
    name = name.strip()
    return _with(folders, FOLDERS, (folder_id, name, at)), {"id": folder_id, "name": name, "created_at": at, "conversation_count": 0}


def _updated(df: DataFrame, key: str, values: dict[str, Column]) -> tuple[DataFrame, int]:
    status = 404 if df.where(F.col("id") == key).isEmpty() else 200
    return df.withColumns({c: F.when(F.col("id") == key, v).otherwise(F.col(c)) for c, v in values.items()}), status


def rename_folder(folders: DataFrame, folder_id: str, name: str) -> tuple[DataFrame, int]:
    return _updated(folders, folder_id, {"name": F.lit(name.strip())})


def delete_folder(folders: DataFrame, conversations: DataFrame, folder_id: str) -> tuple[DataFrame, DataFrame, int]:
    """Folders without it, conversations that were in it now in none, and the status."""
    status = 404 if folders.where(F.col("id") == folder_id).isEmpty() else 204
    free = conversations.withColumn("folder_id", F.when(F.col("folder_id") == folder_id, F.lit(None)).otherwise(F.col("folder_id")))
    return folders.where(F.col("id") != folder_id), free, status


def move(conversations: DataFrame, conversation_id: str, folder_id: str | None) -> tuple[DataFrame, int]:
    """Any folder is accepted; none takes the conversation out of its folder. See ``orphans``."""
    return _updated(conversations, conversation_id, {"folder_id": F.lit(folder_id).cast("string")})


def orphans(conversations: DataFrame, folders: DataFrame) -> DataFrame:
    """Conversations whose folder does not exist."""
    ids = folders.select(F.col("id").alias("folder_id"))
    return conversations.where(F.col("folder_id").isNotNull()).join(ids, "folder_id", "left_anti")


def create_folders(folders: DataFrame, requests: DataFrame) -> DataFrame:
    """All folders of ``requests`` (id, name, created_at) are added at once, so plans don't grow with each."""
    return folders.unionByName(requests.select("id", T.strip(F.col("name")).alias("name"), "created_at"), allowMissingColumns=True)


def start_all(conversations: DataFrame, requests: DataFrame) -> DataFrame:
    """A new conversation for each request (id, query, user_id, created_at)."""
    new = requests.select("id", T.conversation_title(F.col("query")).alias("title"), "user_id", F.lit(None).cast("string").alias("folder_id"), "created_at")
    return conversations.unionByName(new, allowMissingColumns=True)


def add_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Both messages of each of ``turns`` (conversation_id, query, answer, created_at, turn)."""
    both = F.array(*[F.struct(F.lit(role).alias("role"), F.col(text).alias("content"), (F.col("turn") + k).cast("long").alias("turn")) for k, (role, text) in enumerate((("user", "query"), ("assistant", "answer")))])
    new = turns.select("conversation_id", "created_at", F.inline(both))
    new = new.withColumn("id", F.concat_ws("-", "conversation_id", F.col("turn").cast("string")))
    return messages.unionByName(new, allowMissingColumns=True)


def start(conversations: DataFrame, conversation_id: str, query: str, user_id: str, at) -> DataFrame:
    """A new conversation, its title the first 100 characters of the query."""
    return _with(conversations, CONVERSATIONS, (conversation_id, query[:100], user_id, None, at))


def add_turn(messages: DataFrame, conversation_id: str, query: str, answer: str, at, turn: int) -> DataFrame:
    """Both messages of a turn, with the query as the user wrote it."""
    for k, (role, content) in enumerate((("user", query), ("assistant", answer))):
        messages = _with(messages, MESSAGES, (f"{conversation_id}-{turn + k}", conversation_id, role, content, at, turn + k))
    return messages


def delete_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations without ``gone`` (id), and messages without theirs."""
    ids = gone.select("id").distinct()
    return conversations.join(ids, "id", "left_anti"), messages.join(ids.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")


def titles(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """key, title: from the first message of the user."""
    first = messages.where(F.col("role") == "user").groupBy(key).agg(F.min_by("content", F.struct("created_at", "turn")).alias("q"))
    return first.select(key, T.conversation_title(F.col("q")).alias("title"))
