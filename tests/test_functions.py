import math

import pytest
from pyspark.sql import functions as F

from memoriq.functions import scores as S
from memoriq.functions import text as X
from memoriq.functions import times as T
from memoriq.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cosine_edges(spark):
    a = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, V.cosine(a, a)) == pytest.approx(1)
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, V.cosine(a, F.array(F.lit(1.0)))) == 0
    assert one(spark, V.cosine(a, F.lit(None).cast("array<double>"))) == 0
    assert one(spark, V.cosine(a, F.array().cast("array<double>"))) == 0
    assert one(spark, V.clamped_cosine(a, F.array(F.lit(-1.0), F.lit(-2.0)))) == 0


def test_blob_tail_is_ignored(spark):
    v = F.array(F.lit(1.5), F.lit(-2.0)).cast("array<float>")
    assert one(spark, V.from_blob(F.concat(V.to_blob(v), F.lit(b"\x01\x02")))) == [1.5, -2.0]


def test_mean_pool_and_pad(spark):
    vectors = F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0)), F.array(F.lit(9.0), F.lit(9.0)))
    got = one(spark, V.mean_pooled(vectors, F.array(F.lit(1), F.lit(1), F.lit(0))))
    assert got == pytest.approx([0.6, 0.8])
    ids, mask = V.padded(F.array(F.lit(5), F.lit(6)).cast("array<bigint>"), 3)
    assert one(spark, ids) == [5, 6, 0] and one(spark, mask) == [1, 1, 0]


def test_recency(spark):
    at = F.timestamp_micros(F.lit(S.as_of_us("2024-01-01T00:00:00Z")))
    assert one(spark, S.recency(at, "2024-01-31T00:00:00Z", 30)) == pytest.approx(0.5)
    assert one(spark, S.recency(at, "2023-01-31T00:00:00Z", 30)) == 1.0
    assert one(spark, S.recency(F.lit(None).cast("timestamp"), "2024-01-01T00:00:00Z")) == 0.0
    assert one(spark, S.adjacency(F.lit(5.0), 0)) == 0.0


def test_known_identifiers(spark):
    # public known answer of this naming scheme
    assert one(spark, X.safe_profile_id(F.lit("minilm-l6-v2"), F.lit("CoreML(all)"), F.lit(384))) == "minilm_l6_v2_3786b7"
    assert one(spark, X.sanitised(F.lit("9 Ab-ü"))) == "_9_ab_ü" and one(spark, X.sanitised(F.lit(""))) == "default"
    uid = one(spark, X.named_uuid(F.lit("coffee")))
    assert uid[14] == "5" and uid[19] in "89ab" and len(uid) == 36


def test_tokens_and_candidates(spark):
    assert one(spark, X.query_tokens(F.lit("What changed? the Über-Plan, plan x"))) == ["über", "plan"]
    assert one(spark, X.entity_candidates(F.lit("what did Pearl Health say"))) == ["pearl", "health", "pearl health"]
    assert one(spark, X.entity_candidates(F.lit("the of"))) == []


def test_acronym_spans(spark):
    rows = spark.createDataFrame([("a", "é API PR-12 then ABC2.X, xABC ÄBC"), ("b", None), ("c", "")], "id string, text string")
    got = [(r["value"], r["start_offset"], r["end_offset"]) for r in X.spans(rows).collect()]
    text = "é API PR-12 then ABC2.X, xABC ÄBC"
    assert all(text[a:b] == v for v, a, b in got) and [v for v, *_ in got] == ["API", "PR-12", "ABC2.X"]


def test_titles_heads_sections(spark):
    assert one(spark, X.title_of(F.lit("x\n# Big Title\n"), F.lit("a.md"))) == "Big Title"
    assert one(spark, X.title_of(F.lit("x"), F.lit("07-some-note-2024-01-02.md"))) == "Some Note"
    assert one(spark, X.company_of(F.lit("12-pearl-health-2024-05-06"))) == "pearl health"
    text = "One. " * 100
    assert len(one(spark, X.head(F.lit(text), 203))) == 199
    rows = spark.createDataFrame([("n", "intro\n## A\nbody a\n## B\n\n## C\nbody c"), ("m", "plain")], "id string, text string")
    got = [(r["id"], r["heading"], r["body"]) for r in X.sections(rows).orderBy("id", "section_no").collect()]
    assert got == [("m", None, "plain"), ("n", None, "intro"), ("n", "A", "body a"), ("n", "C", "body c")]


def test_commit_tags(spark):
    got = one(spark, X.commit_tags(F.lit("fix: it"), F.array(F.lit("Src/a.py"), F.lit("./b"))))
    assert got == ["bugfix", "git", "src"]
    assert one(spark, X.commit_tags(F.lit("no prefix"), F.lit(None).cast("array<string>"))) == ["git"]


def test_packed_sentences():
    text = "A one. B two. C three.\n\n" + "x" * 25
    pieces = X.packed_sentences(text, 15)
    assert all(len(p) <= 15 for p in pieces) and "".join("".join(p.split()) for p in pieces) == "".join(text.split())


def test_iso_times(spark):
    for good in ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250Z", "2024-01-02T05:04:05+02:00", "2024-01-02"):
        assert one(spark, F.unix_micros(T.parse_iso(F.lit(good)))) is not None
    for bad in ("yesterday", "2024-13-45T00:00:00Z", ""):
        assert one(spark, T.parse_iso(F.lit(bad))) is None
    assert one(spark, T.format_iso(T.parse_iso(F.lit("2024-01-02T05:04:05.250+02:00")))) == "2024-01-02T03:04:05.250Z"


def test_latency_ranks(spark):
    from memoriq.operators.aggregates import latency_stats

    r = latency_stats(spark.createDataFrame([(float(i),) for i in range(1, 11)], "ms double")).first()
    assert (r["p50"], r["p95"], r["p99"], r["count"]) == (6.0, 10.0, 10.0, 10) and r["stdev"] == pytest.approx(math.sqrt(8.25), abs=1e-4)
