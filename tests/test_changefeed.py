import random

import pytest

from memoriq.operators import changefeed as C
from memoriq.operators.changefeed import STATE_TABLES, as_registers, fold_changes, visible
from memoriq.store import BucketStore, SnapshotTable

SCHEMA = "arrival_no long, id string, record_type string, record_id string, operation string, payload string, created_at timestamp, attempt_count int"


def row(n, change, record, op, at, attempt=0, payload=None, kind="memory"):
    import datetime

    when = None if at is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at)
    return (n, change, kind, record, op, payload, when, attempt)


def replay(rows):
    """Brute force: deduplicate deliveries, then walk every record's changes in order."""
    best = {}
    for r in rows:
        if r[2] == "memory" and r[3] is not None:
            key = r[1].lower()
            if key not in best or (r[7] if r[7] is not None else -1, r[0]) > (best[key][7] if best[key][7] is not None else -1, best[key][0]):
                best[key] = r
    state = {}
    for r in sorted(best.values(), key=lambda r: (r[6] is not None, r[6] or 0, r[1].lower())):
        op, record = r[4].strip().lower(), r[3].lower()
        if op in ("insert", "upsert") or (op == "update" and record in state):
            state[record] = r[1].lower()
        elif op == "delete":
            state.pop(record, None)
    return state


@pytest.fixture
def apply_changes(spark, tmp_path):
    return lambda feed, target=None: C.apply_changes(feed, target or BucketStore(spark, f"file://{tmp_path}/new", STATE_TABLES))


@pytest.fixture
def found(spark, apply_changes):
    return lambda rows: {r["record_id"]: r["change_id"] for r in visible(apply_changes(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_random_feeds_match_replay(found):
    rng = random.Random(4)
    rows = []
    for n in range(600):
        change = f"c{rng.randrange(300):03d}"
        change = change.upper() if rng.random() < 0.2 else change
        rows.append(
            row(n, change, rng.choice([None, *[f"R{i}" for i in range(40)], *["r0"] * 30]), rng.choice(["insert", " Update", "UPSERT", "delete ", "noise"]),
                rng.choice([None, rng.randrange(50)]), rng.choice([None, 0, 1, 2]), kind=rng.choice(["memory"] * 9 + ["entity"]))
        )
    assert found(rows) == replay(rows)


def test_update_needs_a_record_and_tombstones_stay(found):
    rows = [row(1, "a", "r1", "update", 5), row(2, "b", "r2", "delete", 9), row(3, "c", "r2", "insert", 3), row(4, "d", "r3", "insert", 1), row(5, "e", "r3", "update", 2)]
    assert found(rows) == {"r3": "e"}


def test_batches_in_any_order_and_replayed(spark, tmp_path, apply_changes):
    rng = random.Random(9)
    rows = [row(n, f"c{n:03d}", f"r{rng.randrange(12)}", rng.choice(["insert", "update", "delete"]), rng.randrange(40)) for n in range(120)]
    parts = [rows[i::3] for i in range(3)]
    table = BucketStore(spark, f"file://{tmp_path}/state", STATE_TABLES, buckets=2, most_rows=10)  # buckets are split on the way
    for part in (parts[2], parts[0], parts[2], parts[1]):
        state = apply_changes(spark.createDataFrame(part, SCHEMA), table)
    assert {r["record_id"]: r["change_id"] for r in visible(state).collect()} == replay(rows)
    assert table.version() > 4 and table.buckets() > 2
    before = {r['record_id'] for r in table.read('state').collect()}
    table.vacuum()
    assert {r['record_id'] for r in table.read('state').collect()} == before


def test_failed_publication_leaves_the_old_snapshot(spark, tmp_path):
    from pyspark.sql import functions as F

    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    table.publish(spark.range(3).toDF("x"))
    with pytest.raises(Exception):
        table.publish(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("x")))
    assert table.version() == 1 and table.read().count() == 3


def test_empty_feed_and_extra_columns(spark, apply_changes):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], SCHEMA)
    assert visible(apply_changes(empty)).count() == 0
    one = spark.createDataFrame([row(1, "a", "r", "insert", 1, payload="{}")], SCHEMA).withColumn("base_seq", F.lit("x")).withColumn("state", F.lit(1))
    assert [tuple(r) for r in visible(fold_changes(as_registers(one))).collect()] == [("r", "a", "{}")]


def test_only_touched_buckets_are_written_and_old_ones_kept(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/b", STATE_TABLES, buckets=8)
    feed = lambda rows: spark.createDataFrame(rows, SCHEMA)
    old = C.apply_changes(feed([row(n, f"c{n}", f"r{n}", "insert", n, payload="{}") for n in range(60)]), store)
    first = dict(store._live()["tables"]["state"])
    C.apply_changes(feed([row(99, "c99", "r7", "delete", 99)]), store)
    second = store._live()["tables"]["state"]
    assert sum(first[b] != second[b] for b in first) == 1
    assert visible(old).count() == 60 and visible(store.read("state")).count() == 59  # the earlier reader still has its files


def test_a_hot_record_and_large_buckets(spark, monkeypatch):
    rows = [row(n, f"c{n:05d}", "hot" if n % 3 else f"r{n}", "update" if n % 2 else "upsert", n) for n in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    small = as_registers(df).mapInArrow(C._folder(False, rows=50, most=200), C.STATE_SCHEMA)  # many partial exports
    got = {r["record_id"]: r["change_id"] for r in visible(fold_changes(small, buckets=3)).collect()}
    assert got == replay(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_mirror_compares_deliveries_across_batches(spark, tmp_path, seed):
    from memoriq.streaming.mirror import Mirror

    rng = random.Random(seed)
    rows = [
        row(n, f"c{rng.randrange(30):03d}", f"r{rng.randrange(8)}", rng.choice(["insert", "update", "UPSERT ", "delete"]), rng.randrange(50), rng.choice([None, 0, 1, 2, 3]), payload="{}")
        for n in range(90)
    ]
    mirror = Mirror(spark, f"file://{tmp_path}/m", buckets=3)
    for k in range(3):
        mirror.apply(spark.createDataFrame(rows[30 * k : 30 * k + 30], SCHEMA), k)
    mirror.apply(spark.createDataFrame(rows[:30], SCHEMA), 1)  # known
    assert {r["record_id"]: r["change_id"] for r in mirror.records().collect()} == replay(rows)


def test_quarantined_rows_are_tried_again(spark, tmp_path):
    from pyspark.sql import functions as F

    from memoriq.streaming.mirror import Mirror

    down = [True]
    mirror = Mirror(spark, f"file://{tmp_path}/m", fault=lambda payload, op: F.when(F.lit(down[0]) & (payload == "[1]"), F.lit("refused")), max_attempts=3)
    empty = spark.createDataFrame([], SCHEMA)
    mirror.apply(spark.createDataFrame([row(1, "a", "r1", "insert", 1, payload="[1]"), row(2, "b", "r2", "insert", 1, payload="[2]")], SCHEMA))
    assert [r["record_id"] for r in mirror.records().collect()] == ["r2"]
    mirror.apply(empty)
    assert [(r["id"], r["attempts"], r["wait_seconds"], r["gave_up"]) for r in mirror.failures().collect()] == [("a", 2, 2.0, False)]
    down[0] = False
    mirror.apply(empty)
    assert sorted(r["record_id"] for r in mirror.records().collect()) == ["r1", "r2"] and mirror.failures().count() == 0
