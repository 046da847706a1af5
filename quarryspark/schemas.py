"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = (
    "chunk_id string, source_id string, chunk_index int, text string, embedding array<float>, filename string, page_number int, "
    "section_heading string, video_id string, video_url string, title string, channel string, timestamp_start bigint, "
    "timestamp_end bigint, url string, domain string, event_at timestamp, source_type string"
)
SEGMENTS = "source_id string, seg_idx int, text string, page_number int, section_heading string"
TRANSCRIPT = "source_id string, pos int, text string, start double, duration double"
USERS = "id string, email string, hashed_password string, is_active boolean, created_at timestamp"
REFRESH_TOKENS = "id string, user_id string, token_hash string, expires_at timestamp, revoked boolean, created_at timestamp"
FOLDERS = "id string, name string, created_at timestamp"
CONVERSATIONS = "id string, title string, user_id string, folder_id string, created_at timestamp"
#: ``turn`` breaks ties of ``created_at``: both messages of a turn are written at once.
MESSAGES = "id string, conversation_id string, role string, content string, created_at timestamp, turn bigint"

TABLES = {"users": USERS, "refresh_tokens": REFRESH_TOKENS, "folders": FOLDERS, "conversations": CONVERSATIONS, "messages": MESSAGES, "chunks": CHUNKS}
SOURCE_TYPES = ("pdf", "youtube", "web")
ROLES = ("user", "assistant")


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create all tables that are missing; chunks are partitioned by their source type."""
    for name, schema in TABLES.items():
        by = " PARTITIONED BY (source_type)" if name == "chunks" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet{by}")


def add_missing_columns(spark: SparkSession, table: str, columns: dict[str, str]) -> list[str]:
    """Add those of ``columns`` (name: type) that the table lacks; says which."""
    there = {c.lower() for c in spark.table(table).columns}
    new = [f"{n} {t}" for n, t in columns.items() if n.lower() not in there]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(new)})")
    return [x.split()[0] for x in new]


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` in order, missing ones null: older files stay readable."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows of ``messages`` with an unknown role, or of ``folders`` with a name that is missing or too long."""
    if table == "messages":
        return df.where(F.col("role").isNull() | ~F.col("role").isin(*ROLES))
    if table == "folders":
        return df.where(F.col("name").isNull() | (F.char_length("name") > 100))
    raise ValueError(table)
