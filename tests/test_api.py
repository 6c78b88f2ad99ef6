import datetime

import pytest
from pyspark.sql import functions as F

from memoriq.api import DRAFT, Engine
from memoriq.functions.enrich import WordEnricher, enriched
from memoriq.functions.stem import stem, stemmed
from memoriq.plans.recall import Options
from memoriq.sources import model as D

AT = "2024-05-01T10:00:00Z"


def test_engine_round_trip(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    drafts = [
        ("Met Sarah Nolan about the API and the red kettle.", None, "slack", "c1", ["work", "b"]),
        ("The violin lesson with Sarah Nolan was good.", datetime.datetime(2024, 4, 30), None, None, None),
        ("Ein ruhiger Abend und die Suppe ist mit MRQ-7 nicht gut.", None, "journal", None, ["work"]),
    ]
    got = e.remember(spark.createDataFrame(drafts, DRAFT), AT).collect()
    assert sorted(r["language"] for r in got) == ["de", "en", "en"]
    assert e.store.version() == 1 and e.outbox_stats().first()["pending"] == 3
    hits, path = e.recall("red kettle", Options(as_of=AT, k=2))
    assert path == "hybrid" and e.load(hits.first()["id"]).first()["tags"] == ["b", "work"]
    one = e.load(hits.first()["id"]).first()
    assert all(one["text"][m["start_offset"] : m["end_offset"]] == m["canonical_name"] for m in one["mentions"]) and len(one["mentions"]) == 1
    assert e.recall_around(anchor_id=one["id"].upper(), k=5).count() == 3
    assert e.forget([one["id"].upper(), "unknown"]) == [one["id"]] and e.forget([one["id"]]) == [one["id"]]
    assert e.list_recent(AT).count() == 2 and e.recall_around(anchor_id=one["id"], k=5).count() == 2
    e.mark(spark.createDataFrame([(e.next_batch(1).first()["id"], datetime.datetime(2024, 5, 2), None)], "id string, at timestamp, error string"))
    assert e.outbox_stats().first()["pending"] == 2
    more = e.remember(spark.createDataFrame([("sarah nolan again, Sarah Nolan", None, None, None, None)], DRAFT), AT)
    assert more.count() == 1 and e.store.read("entities").where("lower(canonical_name) = 'sarah nolan'").count() == 1
    with pytest.raises(ValueError):
        e.remember(spark.createDataFrame([(" ", None, None, None, None)], DRAFT), AT)
    with pytest.raises(ValueError):
        e.recall(" ", Options(as_of=AT))


def test_empty_store_recalls_nothing(spark, tmp_path):
    hits, path = Engine(spark, f"file://{tmp_path}/s").recall("anything", Options(as_of=AT))
    assert path == "local" and hits.count() == 0


def test_relations_and_dates(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    e.relate(spark.createDataFrame([("1", "a", "knows", "b", None, None), ("2", "b", "knows", "c", None, None)], D.RELATION))
    assert e.traverse(spark.createDataFrame([("a",)], "entity_id string"), 1).count() == 2
    assert {(r["matched_text"], str(r["date"])) for r in e.parse_date("due 3.4.2024, May 5, 2024 or 2024-06-07").collect()} == {
        ("3.4.2024", "2024-04-03"), ("May 5, 2024", "2024-05-05"), ("2024-06-07", "2024-06-07"),
    }
    assert e.parse_date("next Tuesday").count() == 0


def test_enricher_columns(spark):
    rows = enriched(spark.createDataFrame([("I am happy and proud, it is good",), (None,), ("",)], "text string"), WordEnricher(dim=32)).collect()
    assert rows[0]["sentiment"] == 1.0 and len(rows[0]["embedding"]) == 32 and rows[1]["sentiment"] == 0.0 and rows[2]["language"] is None


def test_stems(spark):
    # public examples of the algorithm
    pairs = "consign:consign consigned:consign consigning:consign consignment:consign consistency:consist consolation:consol knack:knack knightly:knight knives:knive kneeled:kneel hopping:hop hoping:hope generously:generous communication:communic ties:tie cries:cri skies:sky dying:die news:news relational:relat happily:happili"
    assert {w: stem(w) for w, _ in (p.split(":") for p in pairs.split())} == dict(p.split(":") for p in pairs.split())
    got = spark.createDataFrame([(["cats", "running"],), (None,)], "w array<string>").select(stemmed()(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in got] == [["cat", "run"], None]
