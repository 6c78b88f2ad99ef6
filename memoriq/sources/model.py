"""Record types: schemas and cleaned views of the stored tables.

Views put uuids in lower case. Repeated rows of a memory have one content, so
`memory_rows` keeps them: filters and scores work on the rows as they are scanned,
and `once` leaves one row per id of the narrow result. Nothing is read before a
query needs it: unused columns are pruned through the views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoriq.session import table, uid

MEMORY = ("id string, text string, created_at timestamp, occurred_at timestamp, source string, conversation_id string, language string, sentiment double,"
    " embedding_backend string, embedding_profile string, embedding_dim int, metadata string, tombstoned boolean")
ENTITY = "id string, canonical_name string, entity_type string, aliases array<string>"
MENTION = "id string, memory_id string, entity_id string, start_offset bigint, end_offset bigint, created_at timestamp"
RELATION = "id string, subject_entity_id string, predicate string, object_entity_id string, provenance_memory_id string, created_at timestamp"
TAG = "id string, name string"
MEMORY_TAG = "memory_id string, tag_id string"
OUTBOX = ("id string, record_type string, record_id string, operation string, payload string, created_at timestamp, sent_at timestamp,"
    " last_attempt_at timestamp, last_error string, attempt_count int")
EMBEDDING = "profile_safe_id string, memory_id string, embedding array<float>, updated_at timestamp"
EVAL_MEMORY = "id string, text string, created_at string, occurred_at string, source string, tags array<string>, entities array<string>"
EVAL_QUERY = "id string, query string, grades map<string,int>"


def tags_column() -> Column:
    """Tags of a memory row: its source and language, trimmed and in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(F.lower(F.trim("source")), F.lower(F.trim("language"))))))


def memory_rows(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Sound rows of memories, repeated ones included. `text` also drops those without a text, which the table never has; only then is it read."""
    rows = table(spark, sf_dir, "memories").where(F.col("id").isNotNull() & F.col("created_at").isNotNull())
    rows = rows.where(F.col("text").isNotNull()) if text else rows
    return rows.withColumn("id", uid("id"))


def once(rows: DataFrame, *columns) -> DataFrame:
    """One row per id of these columns."""
    return (rows.select("id", *columns) if columns else rows).dropDuplicates(["id"])


def memory(spark: SparkSession, sf_dir: str, memory_id: str) -> DataFrame:
    """The memory of an id: both ways to write it reach the scan."""
    rows = table(spark, sf_dir, "memories").where(F.col("id").isin(memory_id.lower(), memory_id.upper()))
    return rows.withColumn("id", uid("id")).limit(1)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "mentions")
    return rows.select(uid("id").alias("id"), uid("memory_id").alias("memory_id"), uid("entity_id").alias("entity_id"), "start_offset", "end_offset", "created_at").dropDuplicates(["id"])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").withColumn("id", uid("id"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "relations")
    ids = {c: uid(c) for c in ("id", "subject_entity_id", "object_entity_id", "provenance_memory_id")}
    return rows.withColumns(ids).dropDuplicates(["id"])


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per change: of its deliveries the one with the highest attempt_count, then the last to arrive."""
    rows = table(spark, sf_dir, "outbox")
    key = F.struct(F.coalesce("attempt_count", F.lit(-1)).alias("a"), F.col("arrival_no").alias("b"), F.struct(*rows.columns).alias("row"))
    return rows.groupBy(uid("id").alias("_id")).agg(F.max(key).alias("k")).select("k.row.*")


def vectors(spark: SparkSession, sf_dir: str, profile: str, dim: int = 64) -> DataFrame:
    """(memory_id, embedding) of one profile: the latest row of each memory, if it is a vector of `dim` with a length."""
    rows = table(spark, sf_dir, "memory_embeddings").where(F.col("profile_safe_id") == profile)
    last = rows.groupBy(uid("memory_id").alias("memory_id")).agg(F.max(F.struct("updated_at", "embedding")).alias("v"))
    return last.select("memory_id", F.col("v.embedding").alias("embedding")).where(
        (F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0)
    )
