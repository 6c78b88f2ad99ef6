"""Writes on immutable tables: upserts, replacements, inserts, cascades and status logs, each a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns a memory upsert takes from the incoming row; the others stay as first written.
MEMORY_UPDATES = ["text", "occurred_at", "source", "conversation_id", "language", "sentiment", "tombstoned"]


def latest(changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order` (ascending)."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))).alias("m"))
    return last.select(*keys, *[F.col(f"m.row.{c}").alias(c) for c in rest])


def upsert(target: DataFrame, incoming: DataFrame, key: str, updates: list[str]) -> DataFrame:
    """Rows of both sides by key; where both have one, `updates` come from `incoming` (nulls included), the rest from `target`."""
    old, new = target.withColumn("_old", F.lit(True)), incoming.withColumn("_new", F.lit(True))
    both = old.alias("o").join(new.alias("n"), key, "full")
    cols = []
    for c in target.columns:
        if c == key:
            cols.append(F.col(key))
        elif c not in incoming.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in updates:
            cols.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return both.select(*cols)


def replace_children(target: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """A parent's rows are replaced by its incoming ones; parents with none keep theirs."""
    kept = target.join(incoming.select(parent).distinct(), parent, "left_anti")
    return kept.select(*target.columns).unionByName(incoming.select(*target.columns))


def insert_missing(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    new = incoming.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def delete_cascade(ids: DataFrame, memories: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """`ids` (id) leave the memories and every child table (column memory_id)."""
    gone = ids.select("id").distinct()
    out = {"memories": memories.join(gone, "id", "left_anti")}
    return out | {n: c.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti").select(*c.columns) for n, c in children.items()}


def first_spelling(names: DataFrame, order: list[Column]) -> DataFrame:
    """One row per lower-case name and type: the spelling and id that came first."""
    key = [F.lower("canonical_name").alias("key"), F.col("entity_type")]
    first = names.select(*key, F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.struct("id", "canonical_name").alias("row")).alias("s"))
    return first.groupBy("key", "entity_type").agg(F.min("s").alias("s")).select("key", "entity_type", F.col("s.row.id").alias("id"), F.col("s.row.canonical_name").alias("canonical_name"))


def soft_deleted(memories: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Memories with those in `forgotten` (id) tombstoned; doing it again changes nothing."""
    marks = forgotten.select("id", F.lit(True).alias("_gone")).distinct()
    flagged = F.coalesce("_gone", "tombstoned", F.lit(False))
    return memories.join(marks, "id", "left").withColumn("tombstoned", flagged).drop("_gone").select(*memories.columns)


def with_status(outbox: DataFrame, log: DataFrame) -> DataFrame:
    """Outbox rows after a status log (id, at, error): an error counts an attempt and leaves the row pending, none marks it sent."""
    per = log.groupBy("id").agg(
        F.max(F.when(F.col("error").isNull(), F.col("at"))).alias("_sent"),
        F.max("at").alias("_last"),
        F.max(F.struct("at", "error"))["error"].alias("_error"),
        F.count_if(F.col("error").isNotNull()).cast("int").alias("_failed"),
    )
    rows = outbox.join(per, "id", "left")
    touched = F.col("_last").isNotNull()
    rows = rows.withColumns(
        {
            "sent_at": F.coalesce("_sent", "sent_at"),
            "last_attempt_at": F.coalesce("_last", "last_attempt_at"),
            "last_error": F.when(touched, F.col("_error")).otherwise(F.col("last_error")),
            "attempt_count": F.col("attempt_count") + F.coalesce("_failed", F.lit(0)),
        }
    )
    return rows.select(*outbox.columns)


def profile_guarded(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """Vectors of registered profiles (profile_safe_id, dim) with the profile's dimension."""
    ok = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).join(profiles.select("profile_safe_id", "dim"), "profile_safe_id")
    return ok.where(F.size("embedding") == F.col("dim")).drop("dim")


def backoff_seconds(attempts: Column, first: float = 1.0, most: float = 30.0) -> Column:
    """1, 2, 4 ... seconds up to `most`; none before the first failure."""
    return F.when(attempts > 0, F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempts - 1))).otherwise(F.lit(0.0))
