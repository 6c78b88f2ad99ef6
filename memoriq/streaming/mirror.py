"""Outbox mirror on Structured Streaming: routed changes, row-level failures, idempotent snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoriq.operators.changefeed import DELIVERY, STATE_SCHEMA, best_deliveries, better, fold_changes, registers_of, visible
from memoriq.operators.merge import backoff_seconds
from memoriq.session import written
from memoriq.store import BucketStore


def routed(batch: DataFrame) -> DataFrame:
    """Rows with `route`: upsert or delete of a memory, or ack for what the mirror doesn't hold."""
    op = F.lower(F.trim("operation"))
    mine = (F.col("record_type") == "memory") & F.col("record_id").isNotNull()
    return batch.withColumn("route", F.when(mine & op.isin("insert", "update", "upsert"), "upsert").when(mine & (op == "delete"), "delete").otherwise("ack"))


def fault_of(row_payload: Column, operation: Column) -> Column:
    """Why a change can't be applied, or null: a payload that isn't JSON."""
    bad = row_payload.isNotNull() & F.try_parse_json(row_payload).isNull()
    return F.when(bad, F.lit("payload is not JSON"))


FEED = "arrival_no bigint, id string, record_type string, record_id string, operation string, payload string, created_at timestamp, attempt_count int"
QUARANTINE = FEED + ", fault string, attempts int"
TABLES = {"changes": ("change_id", DELIVERY), "state": ("record_id", STATE_SCHEMA), "quarantine": ("id", QUARANTINE)}


class Mirror:
    """Applies outbox files to bucketed tables: `changes` (the delivery that counts of each change), `state` and `quarantine`.

    A micro-batch is folded into registers that are maxima over the sequence of
    changes, so late batches and batches out of order end in the same state. Where a
    delivery takes the place of one from an earlier batch, the records of both are
    folded anew from their changes. Rows with a fault go to quarantine and are tried
    again with every later batch, `max_attempts` times; the rest of the batch is
    applied. Each batch touches only its buckets and is one publication, which also
    holds the batch's number: a batch delivered again is known and left out.
    """

    def __init__(self, spark: SparkSession, root: str, fault: Callable[[Column, Column], Column] = fault_of, max_attempts: int | None = None, buckets: int = 16):
        self.spark, self.fault, self.max_attempts = spark, fault, max_attempts
        self.store = BucketStore(spark, f"{root}/tables", TABLES, buckets)
        self.root = root

    def _gave_up(self) -> Column:
        return F.lit(False) if self.max_attempts is None else F.col("attempts") >= self.max_attempts

    def apply(self, batch: DataFrame, batch_id: int | None = None) -> None:
        store = self.store
        last = store.note().get("batch", -1)
        if batch_id is not None and batch_id <= last:
            return
        feed = [c.split()[0] for c in FEED.split(", ")]
        held = store.read("quarantine")
        rows = routed(batch).where(F.col("route") != "ack").select(*feed, F.lit(0).alias("attempts"))
        rows = rows.unionByName(held.where(~self._gave_up()).select(*feed, "attempts"))
        rows = written(rows.withColumn("fault", self.fault(F.col("payload"), F.col("operation"))), "mirror-batch")
        store.fit("changes", rows.count())
        new = written(best_deliveries(rows.where(F.col("fault").isNull())), "mirror-deliveries")
        changed = store.touched("changes", new)
        old = store.read("changes", changed)
        merged = written(better(old.unionByName(new)), "mirror-changes")
        place = ["change_id", "attempt_count", "arrival_no"]
        lost = old.join(merged.select(*place), place, "left_anti")
        wins = new.join(merged.select(*place), place, "left_semi")
        replaced = lost.select("change_id", "record_id").unionByName(wins.join(lost.select("change_id"), "change_id", "left_semi").select("change_id", "record_id"))
        again = written(replaced.select("record_id").distinct(), "mirror-again")
        touched = store.touched("state", wins.select("record_id").unionByName(again))
        state = store.read("state", touched)
        if not again.isEmpty():
            rest = [b for b in range(store.buckets()) if b not in changed]
            state = state.join(again, "record_id", "left_anti")
            every = merged.unionByName(store.read("changes", rest))
            wins = wins.join(again, "record_id", "left_anti").unionByName(every.join(again, "record_id", "left_semi").select(*wins.columns))
        folded = fold_changes(registers_of(wins), state, store.buckets())
        failed = rows.where(F.col("fault").isNotNull()).withColumn("attempts", F.col("attempts") + 1).unionByName(held.where(self._gave_up()))
        failed = failed.groupBy("id").agg(F.max(F.struct(F.coalesce("attempt_count", F.lit(-1)), "arrival_no", F.struct(*failed.columns).alias("row"))).alias("m"), F.max("attempts").alias("n"))
        failed = failed.select("m.row.*", "n").withColumn("attempts", F.col("n")).drop("n")
        # a later good delivery settles a failed one
        settled = merged.select(F.col("change_id").alias("key"), F.col("attempt_count").alias("good"))
        failed = failed.join(settled, (F.lower("id") == F.col("key")) & (F.col("good") >= F.coalesce("attempt_count", F.lit(-1))), "left_anti")
        tables = {"changes": (merged, changed), "state": (folded, touched), "quarantine": (failed, None)}
        store.commit(tables, {"batch": last + 1 if batch_id is None else batch_id})
        store.vacuum()

    def run(self, source: str, schema, max_files: int = 100, once: bool = True):
        """Stream the outbox files of a folder; `once` handles what is there and ends."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()

    def records(self) -> DataFrame:
        return visible(self.store.read("state"))

    def failures(self) -> DataFrame:
        """(id, fault, attempts, wait_seconds, gave_up)."""
        return self.store.read("quarantine").select("id", "fault", "attempts", backoff_seconds(F.col("attempts")).alias("wait_seconds"), self._gave_up().alias("gave_up"))


def alarms(stats: DataFrame, now_us: int, most_pending: int = 1000, oldest_seconds: int = 3600) -> DataFrame:
    """Outbox statistics with whether the backlog is too long or too old."""
    age = (F.lit(now_us) - F.col("oldest_us")) / 1e6
    return stats.withColumn("too_many", F.col("pending") >= most_pending).withColumn("too_old", F.coalesce(age >= oldest_seconds, F.lit(False)))


def windowed_counts(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums per window and key, for a stream (late rows up to `late`) or a table."""
    rows = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.unix_micros("w.start").alias("start_us"), by, "n", "total"
    )
