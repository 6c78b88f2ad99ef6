"""Rebuild the present state of a table from its change feed.

Each record's history folds into two registers: the latest change that decides
existence (insert, upsert, delete; a delete stays as tombstone) and the latest
update. Both are maxima over the change's sequence, so folding is commutative,
associative and idempotent: late, repeated and out-of-order changes, partial
folds and replays of a batch all reach the same state. A record exists if its
deciding change creates; its content is the later of the two registers, because
an update after the deciding change found the record and an earlier one was
replaced by it.

The fold runs in an embedded DuckDB, one per bucket of records: Arrow batches are
upserted with a conditional ON CONFLICT update that compares stored sequences. A
first fold happens where the deliveries were deduplicated (before the shuffle by
bucket), so a record holding a third of the feed arrives as one row per task. The
number of buckets follows the number of rows, which bounds each one's table, since
its primary key has to stay in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoriq.session import uid, written
from memoriq.store import BucketStore

STATE_SCHEMA = (
    "record_id string, base_seq string, base_deletes boolean, base_change string, base_payload string,"
    " upd_seq string, upd_change string, upd_payload string"
)
STATE_COLUMNS = [c.split()[0] for c in STATE_SCHEMA.split(",")]

#: Text collation of the engine is binary, as is the comparison of sequences.
_DDL = """CREATE TABLE state(record_id VARCHAR PRIMARY KEY, base_seq VARCHAR, base_deletes BOOLEAN, base_change VARCHAR,
 base_payload VARCHAR, upd_seq VARCHAR, upd_change VARCHAR, upd_payload VARCHAR)"""
_UPSERT = """
INSERT INTO state
SELECT record_id, max(base_seq), arg_max(base_deletes, base_seq), arg_max(base_change, base_seq),
  arg_max_null(base_payload, base_seq), max(upd_seq), arg_max(upd_change, upd_seq), arg_max_null(upd_payload, upd_seq)
FROM batch GROUP BY record_id
ON CONFLICT (record_id) DO UPDATE SET
  base_deletes = CASE WHEN coalesce(excluded.base_seq > base_seq, excluded.base_seq IS NOT NULL) THEN excluded.base_deletes ELSE base_deletes END,
  base_change = CASE WHEN coalesce(excluded.base_seq > base_seq, excluded.base_seq IS NOT NULL) THEN excluded.base_change ELSE base_change END,
  base_payload = CASE WHEN coalesce(excluded.base_seq > base_seq, excluded.base_seq IS NOT NULL) THEN excluded.base_payload ELSE base_payload END,
  base_seq = CASE WHEN coalesce(excluded.base_seq > base_seq, excluded.base_seq IS NOT NULL) THEN excluded.base_seq ELSE base_seq END,
  upd_change = CASE WHEN coalesce(excluded.upd_seq > upd_seq, excluded.upd_seq IS NOT NULL) THEN excluded.upd_change ELSE upd_change END,
  upd_payload = CASE WHEN coalesce(excluded.upd_seq > upd_seq, excluded.upd_seq IS NOT NULL) THEN excluded.upd_payload ELSE upd_payload END,
  upd_seq = CASE WHEN coalesce(excluded.upd_seq > upd_seq, excluded.upd_seq IS NOT NULL) THEN excluded.upd_seq ELSE upd_seq END
WHERE coalesce(excluded.base_seq > base_seq, excluded.base_seq IS NOT NULL)
   OR coalesce(excluded.upd_seq > upd_seq, excluded.upd_seq IS NOT NULL)
"""


DELIVERY = "change_id string, attempt_count int, arrival_no long, record_id string, op string, created_at timestamp, payload string"


def _folder(by_bucket: bool, memory_mb: int = 512, rows: int = 65_536, most: int = 500_000):
    """A function that upserts Arrow batches into an embedded table and exports it: at the end of each bucket, or after every `most` rows."""

    def fold(batches: Iterator) -> Iterator:
        import tempfile

        import duckdb
        import numpy as np
        import pyarrow as pa

        with tempfile.TemporaryDirectory() as spill:  # only overflow of this task, never shared
            con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": spill})
            con.execute(_DDL)
            held, waiting, inside, here = [], 0, 0, None

            def flush():
                nonlocal waiting
                if held:
                    con.register("batch", pa.Table.from_batches(held))
                    con.execute(_UPSERT)
                    con.unregister("batch")
                    held.clear()
                waiting = 0

            def export():
                nonlocal inside
                flush()
                if inside:
                    yield from con.sql(f"SELECT {', '.join(STATE_COLUMNS)} FROM state").to_arrow_reader(10_000)
                    con.execute("DROP TABLE state")
                    con.execute(_DDL)
                inside = 0

            for b in batches:
                parts = [(None, b)] if b.num_rows else []
                if by_bucket and b.num_rows:
                    k = b.column("bucket").to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]).tolist()
                    parts = [(int(k[i]), b.slice(i, j - i)) for i, j in zip(at, [*at[1:], b.num_rows], strict=True)]
                for bucket, part in parts:
                    if inside and (bucket != here if by_bucket else inside >= most):
                        yield from export()
                    here = bucket
                    held.append(part)
                    waiting += part.num_rows
                    inside += part.num_rows
                    if waiting >= rows:
                        flush()
            yield from export()
            con.close()

    return fold


def best_deliveries(feed: DataFrame, record_type: str = "memory") -> DataFrame:
    """One row per change (DELIVERY): the delivery that counts.

    Rows of other record types or without a record_id are left out first. Of the
    deliveries of one change the highest attempt_count counts (null is lowest),
    among equals the last to arrive. Letter case and outer blanks of `operation`
    mean nothing.
    """
    rows = feed.where((F.col("record_type") == record_type) & F.col("record_id").isNotNull() & F.col("id").isNotNull()).select(
        uid("id").alias("change_id"),
        F.coalesce("attempt_count", F.lit(-1)).alias("attempt_count"),
        "arrival_no",
        uid("record_id").alias("record_id"),
        F.lower(F.trim("operation")).alias("op"),
        "created_at",
        "payload",
    )
    return better(rows)


def better(deliveries: DataFrame) -> DataFrame:
    """Of several deliveries (DELIVERY) of a change the one that counts."""
    rest = [c.split()[0] for c in DELIVERY.split(", ")][1:]
    return deliveries.groupBy("change_id").agg(F.max(F.struct(*rest)).alias("d")).select("change_id", "d.*")


def registers_of(deliveries: DataFrame) -> DataFrame:
    """Each change as a half-filled state row. Unknown operations are no changes; a null created_at sorts first."""
    micros = F.coalesce(F.unix_micros("created_at") + F.lit(1 << 61), F.lit(0))
    seq = F.concat(F.lpad(micros.cast("string"), 20, "0"), F.col("change_id"))
    base, upd = F.col("op").isin("insert", "upsert", "delete"), F.col("op") == "update"
    return deliveries.where(base | upd).select(
        "record_id",
        F.when(base, seq).alias("base_seq"),
        F.when(base, F.col("op") == "delete").alias("base_deletes"),
        F.when(base, F.col("change_id")).alias("base_change"),
        F.when(base, F.col("payload")).alias("base_payload"),
        F.when(upd, seq).alias("upd_seq"),
        F.when(upd, F.col("change_id")).alias("upd_change"),
        F.when(upd, F.col("payload")).alias("upd_payload"),
    )


def as_registers(feed: DataFrame, record_type: str = "memory") -> DataFrame:
    return registers_of(best_deliveries(feed, record_type))


def fold_changes(registers: DataFrame, state: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Fold register rows, and an earlier state if there is one, to one row per record."""
    part = registers.mapInArrow(_folder(False), STATE_SCHEMA)
    rows = part if state is None else part.unionByName(state.select(*STATE_COLUMNS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int"))
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_folder(True), STATE_SCHEMA)


def visible(state: DataFrame) -> DataFrame:
    """The records that exist: record_id, change_id and payload of the present content."""
    later = F.coalesce(F.col("upd_seq") > F.col("base_seq"), F.lit(False))
    return state.where(F.col("base_seq").isNotNull() & ~F.col("base_deletes")).select(
        "record_id",
        F.when(later, F.col("upd_change")).otherwise(F.col("base_change")).alias("change_id"),
        F.when(later, F.col("upd_payload")).otherwise(F.col("base_payload")).alias("payload"),
    )


STATE_TABLES = {"state": ("record_id", STATE_SCHEMA)}


def apply_changes(feed: DataFrame, target: BucketStore, record_type: str = "memory") -> DataFrame:
    """Apply a change feed to the table `state` of `target` and return the state (registers, tombstones included).

    The buckets that the feed touches are folded over their live rows and all of
    them are published in one pointer swap; a failure leaves the old state live. An
    empty feed leaves it unchanged. Further columns of the feed are not read. Of
    deliveries of one change the best counts within a feed; feeds that may repeat
    changes of earlier ones go through `streaming.mirror`, which keeps them.
    """
    target.fit("state", feed.count())
    registers = written(as_registers(feed, record_type).mapInArrow(_folder(False), STATE_SCHEMA), "feed-registers")
    touched = target.touched("state", registers)
    folded = fold_changes(registers, target.read("state", touched), target.buckets())
    target.commit({"state": (folded, touched)})
    return target.read("state")
