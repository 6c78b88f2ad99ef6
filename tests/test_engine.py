import datetime
import json

import pytest
from pyspark.sql import functions as F

from memoriq.operators import aggregates as A
from memoriq.operators import branches as B
from memoriq.operators import filters as P
from memoriq.operators import graph as G
from memoriq.operators import merge as M
from memoriq.operators import quality as Q
from memoriq.plans import recall as R
from memoriq.sources import model as D
from memoriq.sources import readers, writers
from memoriq.streaming.mirror import Mirror, alarms

AS_OF = "2024-03-01T00:00:00Z"


def when(day, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)


@pytest.fixture
def store(spark):
    memories = spark.createDataFrame(
        [
            ("m1", "red kettle on the stove", when(1), None, "git", "c1", "en", 0.0, None, None, None, None, False),
            ("m2", "blue violin lesson", when(2), when(0), "slack", "c1", "en", 0.1, None, None, None, None, False),
            ("m3", "red red violin", when(3), None, None, None, "de", 0.2, None, None, None, None, None),
            ("m4", "nothing here", when(4), None, "git", "c2", None, None, None, None, None, None, True),
            ("m5", "far away", when(5), None, "git", "c2", "en", None, None, None, None, None, False),
        ],
        D.MEMORY,
    )
    vectors = spark.createDataFrame([("m1", [1.0, 0.0]), ("m2", [0.6, 0.8]), ("m4", [1.0, 0.0])], "memory_id string, embedding array<float>")
    mentions = spark.createDataFrame(
        [("x1", "m1", "e1", 0, 3, None), ("x2", "m5", "e1", 0, 3, None), ("x3", "m5", "e1", 4, 7, None), ("x4", "m3", None, 0, 1, None), ("x5", "m2", "e9", 0, 1, None)], D.MENTION
    )
    entities = spark.createDataFrame([("e1", "Kettle", "Other", None), ("e2", "Violin", "Other", ["fiddle"])], D.ENTITY)
    return memories, vectors, mentions, entities


def query():
    return F.array(F.lit(1.0), F.lit(0.0))


def terms(*w):
    return F.array(*[F.lit(x) for x in w]) if w else F.array().cast("array<string>")


def test_hybrid_scores(store):
    o = R.Options(as_of=AS_OF, k=5, budgets=(1, 5, 5))
    rows = {r["id"]: r for r in R.recall_hybrid(*store, query(), terms("violin"), terms("kettle"), o).collect()}
    assert set(rows) == {"m1", "m2", "m3", "m5"}  # m4 is tombstoned
    assert rows["m1"]["branches"] == ["ent", "vec"] and rows["m5"]["branches"] == ["ent"]
    assert rows["m2"]["semantic"] == 0.0 and rows["m2"]["lexical"] == 1.0  # a seed found by words only isn't scored again
    assert rows["m1"]["semantic"] == pytest.approx(1.0) and rows["m5"]["graph"] == 1.0


def test_neighbours_count_mentions(store, spark):
    seeds = spark.createDataFrame([("m1",)], "id string")
    assert [tuple(r) for r in G.neighbours(seeds, store[2]).collect()] == [("m5", 2)]


def test_disabled_branches_give_nothing(store):
    o = R.Options(as_of=AS_OF, budgets=(0, 0, 0))
    assert R.recall_hybrid(*store, query(), terms(), terms(), o).count() == 0


def test_local_prefilter_comes_before_scoring(store):
    o = R.Options(as_of=AS_OF, k=5, prefilter=2)
    assert [r["id"] for r in R.recall_local(store[0], store[1], query(), o).collect()] == ["m5", "m3"]


def test_filters(store):
    m = store[0]
    got = lambda f, **k: sorted(r["id"] for r in P.filtered(m, f, **k).select("id").collect())
    assert got(P.Filters()) == ["m1", "m2", "m3", "m5"]
    assert got(P.Filters(since="2024-01-03T00:00:00Z")) == ["m3", "m5"]
    assert got(P.Filters(since="2024-01-03T00:00:00Z"), lax=True) == ["m2", "m3", "m5"]
    assert got(P.Filters(source="git", conversation_id="c2")) == ["m5"]
    assert got(P.Filters(tags=("de",)), tags=D.tags_column()) == ["m3"]


def test_around_and_recent(store, spark):
    anchor = spark.createDataFrame([(when(2),)], "at timestamp")
    rows = R.recall_around(store[0], anchor, 86_400, 10).collect()
    assert [r["id"] for r in rows] == ["m1", "m3", "m2"] and rows[-1]["score"] == 0.0
    many = R.around_many(store[0], anchor.select(F.lit(7).alias("anchor_id"), "at"), 86_400.0, 2).collect()
    assert sorted((r["rank"], r["id"]) for r in many) == [(1, "m1"), (2, "m3")]
    assert [r["id"] for r in R.list_recent(store[0], R.Options(as_of=AS_OF), 2).collect()] == ["m5", "m3"]


def test_batch_vectors_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).round(1)
    v = spark.createDataFrame([(f"v{i:03d}", [float(a) for a in r]) for i, r in enumerate(x)] + [("short", [1.0]), ("none", None)], "memory_id string, embedding array<float>")
    q = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(5)], "query_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in B.batch_vector_branch(v, q, 4, block=2).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    for i in range(5):
        best = sorted(range(300), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:4]
        assert [got[i, r + 1] for r in range(4)] == [f"v{j:03d}" for j in best]
    assert B.batch_vector_branch(v, q.limit(0), 4).count() == 0


def test_merges(store, spark):
    old = spark.createDataFrame([("a", "one", 1), ("b", "two", 2)], "id string, text string, created int")
    new = spark.createDataFrame([("b", None, 9), ("c", "new", 3)], "id string, text string, created int")
    got = sorted(tuple(r) for r in M.upsert(old, new, "id", ["text"]).collect())
    assert got == [("a", "one", 1), ("b", None, 2), ("c", "new", 3)]
    latest = M.latest(spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("j", 1, "y")], "k string, t int, v string"), ["k"], [F.col("t")])
    assert sorted(tuple(r) for r in latest.select("k", "t", "v").collect()) == [("j", 1, "y"), ("k", 2, None)]
    names = spark.createDataFrame([("2", "Ann", "P"), ("1", "ANN", "P"), ("3", "ann", "Q")], "id string, canonical_name string, entity_type string")
    assert sorted(r["canonical_name"] for r in M.first_spelling(names, [F.col("id")]).collect()) == ["ANN", "ann"]
    left = M.delete_cascade(spark.createDataFrame([("m1",)], "id string"), store[0], mentions=store[2])
    assert left["memories"].count() == 4 and left["mentions"].count() == 4


def test_status_log(spark):
    outbox = spark.createDataFrame([("a", None, None, None, 0), ("b", None, None, "old", 2)], "id string, sent_at timestamp, last_attempt_at timestamp, last_error string, attempt_count int")
    log = spark.createDataFrame([("a", when(1), "down"), ("a", when(2), None), ("b", when(1), "bad")], "id string, at timestamp, error string")
    rows = {r["id"]: r for r in M.with_status(outbox, log).collect()}
    assert rows["a"]["sent_at"] == when(2) and rows["a"]["attempt_count"] == 1 and rows["a"]["last_error"] is None
    assert rows["b"]["sent_at"] is None and rows["b"]["attempt_count"] == 3 and rows["b"]["last_error"] == "bad"
    stats = A.outbox_stats(M.with_status(outbox.withColumn("created_at", F.lit(when(0))), log)).first()
    assert stats["pending"] == 1 and alarms(spark.createDataFrame([stats]), 10**18).first()["too_old"]


def test_metrics(spark):
    grades = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 1), ("q2", "z", 1)], "query_id string, id string, grade int")
    ranked = spark.createDataFrame([("q1", "x", 1, 0.0), ("q1", "b", 2, 0.0), ("q3", "a", 1, 0.0)], "query_id string, id string, rank int, lexical double")
    per = {r["query_id"]: r for r in Q.metrics(ranked, grades).collect()}
    assert per["q1"]["rr"] == 0.5 and per["q1"]["ndcg"] == pytest.approx((1 / 1.5849625) / (3 + 1 / 1.5849625)) and per["q2"]["rr"] == 0.0 and "q3" not in per
    labels = {r["query_id"]: r["label"] for r in Q.failure_labels(ranked, grades, spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")).collect()}
    assert labels == {"q1": "rank-issue", "q2": "no-results", "q3": "no-truth"}
    assert Q.coarse_grid(spark).count() == 20


def test_mirror_stream(spark, tmp_path):
    def write(rows, name):
        spark.createDataFrame(rows, D.OUTBOX + ", arrival_no bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/outbox")

    def row(n, change, record, op, payload="{}"):
        return (change, "memory", record, op, payload, when(n), None, None, None, 0, n)

    write([row(1, "c1", "r1", "insert"), row(2, "c2", "r2", "upsert", "{broken"), row(3, "c3", "r3", "insert")], "a")
    mirror = Mirror(spark, f"file://{tmp_path}/mirror", max_attempts=1)
    mirror.run(f"{tmp_path}/outbox", D.OUTBOX + ", arrival_no bigint").awaitTermination()
    assert sorted(r["record_id"] for r in mirror.records().collect()) == ["r1", "r3"]
    assert [(r["id"], r["attempts"], r["gave_up"]) for r in mirror.failures().collect()] == [("c2", 1, True)]
    write([row(5, "c5", "r3", "delete"), row(4, "c4", "r3", "update"), row(6, "c2", "r2", "upsert")], "b")
    mirror.run(f"{tmp_path}/outbox", D.OUTBOX + ", arrival_no bigint").awaitTermination()
    assert sorted(r["record_id"] for r in mirror.records().collect()) == ["r1", "r2"]
    before = sorted(tuple(r) for r in mirror.records().collect())
    mirror.apply(spark.read.schema(D.OUTBOX + ", arrival_no bigint").parquet(f"{tmp_path}/outbox"), 1)  # a replay changes nothing
    assert sorted(tuple(r) for r in mirror.records().collect()) == before


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "memories.jsonl").write_text('{"id": "m1", "text": "a", "tags": ["x"]}\n\n{"id": "m2", "text": "b"}\n')
    (tmp_path / "queries.jsonl").write_text('{"id": "q", "query": "?", "grades": {"m1": 2}}\n')
    memories, queries = readers.read_corpus(spark, str(tmp_path))
    assert memories.count() == 2 and queries.first()["grades"] == {"m1": 2}
    (tmp_path / "notes/node_modules").mkdir(parents=True)
    (tmp_path / "notes/1-a-note-2024-01-02.md").write_text("## One\nbody")
    (tmp_path / "notes/node_modules/skip.md").write_text("x")
    notes = readers.read_notes(spark, f"{tmp_path}/notes")
    assert [(r["path"], r["title"]) for r in notes.collect()] == [("1-a-note-2024-01-02.md", "A Note")]
    assert readers.note_sections(notes).first()["heading"] == "One"
    (tmp_path / "log").write_bytes(b"abcdef1234\n2024-01-02T00:00:00Z\nfix: API call\nlong\nbody\x00bbbbbb1234\n2024-01-03T00:00:00Z\nplain\n\x00")
    (tmp_path / "files").write_bytes(b"abcdef1234\nSrc/x.py\n\x00")
    commits = {r["id"]: r for r in readers.read_commits(spark, f"{tmp_path}/log", f"{tmp_path}/files").collect()}
    assert commits["mabcdef12"]["tags"] == ["bugfix", "git", "src"] and commits["mabcdef12"]["text"] == "fix: API call\nlong\nbody" and commits["mbbbbbb12"]["tags"] == ["git"]
    writers.write_jsonl(memories, f"{tmp_path}/out")
    assert readers.read_jsonl(spark, f"{tmp_path}/out", D.EVAL_MEMORY).count() == 2
    assert json.loads(writers.response(memories.orderBy("id")).first()["json"]) == {"id": "m1", "tags": ["x"], "text": "a"}
    assert writers.markdown(memories.select("id", "text"), "id").first()["markdown"].endswith("| m1 | a |\n| m2 | b |")
    import hashlib

    (tmp_path / "model").mkdir()
    (tmp_path / "model/w.bin").write_bytes(b"w")
    files = readers.verified_files(spark, [f"{tmp_path}/model"], {"w.bin": hashlib.sha256(b"w").hexdigest(), "gone": "0"})
    assert {r["file"]: r["ok"] for r in files.collect()} == {"w.bin": True, "gone": False}


def test_traverse(spark):
    rel = spark.createDataFrame([("1", "a", "p", "b", None, None), ("2", "b", "p", "c", None, None), ("3", "c", "p", "a", None, None), ("4", "c", "p", "d", None, None)], D.RELATION)
    got = sorted(tuple(r) for r in G.traverse(rel, spark.createDataFrame([("a",)], "entity_id string"), 2).collect())
    assert got == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_filters_reach_the_scan(spark, tmp_path):
    from memoriq.plans import catalogue as K

    spark.createDataFrame([("A1", "x", when(0), None, "slack", "c00-000001", "en", 0.0, None, None, None, None, None)], D.MEMORY).write.parquet(f"{tmp_path}/memories.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    for name, column in (("filter_source_conv", "source"), ("filter_effective_time", "created_at"), ("tombstone_antijoin", "tombstoned"), ("hit_json", "conversation_id"), ("date_window", "created_at")):
        plan = getattr(K, name)(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert any(f"({column}," in p for p in plan.split("PushedFilters: ")[1:]), name
        assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert K.filter_source_conv(spark, str(tmp_path)).count() == 1


def test_around_many_admits_either_time(spark):
    near, far = when(0), when(500)
    rows = spark.createDataFrame([("a", near, far), ("b", far, near), ("c", far, far), ("d", near, None), ("d", near, None)], "id string, created_at timestamp, occurred_at timestamp").withColumn("tombstoned", F.lit(False))
    anchors = spark.createDataFrame([(1, near)], "anchor_id int, at timestamp")
    got = [r["id"] for r in R.around_many(rows, anchors, 3600, 10).orderBy("rank").collect()]
    assert got == ["b", "d", "a"] == [r["id"] for r in R.recall_around(rows, anchors, 3600, 10).collect()]
