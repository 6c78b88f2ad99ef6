import datetime

import numpy as np
from pyspark.sql import functions as F

from memoriq.llm import knn as K
from memoriq.llm.level import grades, reading_levels

SCHEMA = "profile string, id string, embedding array<float>, updated_at timestamp, node string"
NOW = datetime.datetime(2024, 1, 1)


def vectors(spark, n=900, d=16, seed=0):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, d))
    x[n // 2 :] = x[: n - n // 2] + g.normal(size=(n - n // 2, d)) * 0.12
    x *= g.uniform(0.2, 5, (n, 1))
    rows = [("p" if i % 3 else "q", f"v{i:04d}", [float(v) for v in r], NOW, None) for i, r in enumerate(x)]
    return rows


def brute(rows, k, least):
    out = {}
    for p in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == p]
        x = np.array([r[2] for r in own], dtype=np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        for i, r in enumerate(own):
            near = sorted((j for j in range(len(own)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], own[j][1]))[:k]
            out.update({(r[1], own[j][1]): None for j in near})
    return set(out)


def test_recall_against_brute_force(spark):
    rows = vectors(spark)
    got = {(r["id"], r["neighbour"]) for r in K.similar_vectors(spark.createDataFrame(rows, SCHEMA), k=3, least=0.9, dim=16).collect()}
    want = brute(rows, 3, 0.9)
    assert len(want) > 300 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_small_windows_join_over_partition_edges(spark):
    rows = vectors(spark, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    few = {(r["id"], r["neighbour"]) for r in K.similar_vectors(df.repartition(7), k=3, least=0.9, dim=16, window=12).collect()}
    want = brute(rows, 3, 0.9)
    assert len(few & want) >= 0.9 * len(want)


def test_every_vector_has_its_neighbours(spark):
    g = np.random.default_rng(5)
    rows = [("p" if i % 10 else "q", f"v{i:04d}", [float(v) for v in g.normal(size=64)], NOW, None) for i in range(5000)]
    got = {}
    for r in K.similar_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), k=5).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert len(got) == 5000 and all(len(set(v)) == 5 for v in got.values())
    want = brute(rows, 5, -1)
    assert len({(i, j) for i, v in got.items() for j in v} & want) >= 0.95 * len(want)


def test_dense_group_of_a_third_of_the_rows(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + x[::3] * 0.01  # cosines of 0.9999
    rows = [("p", f"v{i:05d}", v.tolist(), NOW, None) for i, v in enumerate(x)]
    near = K.similar_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), k=5, least=0.9).select("id", "neighbour").collect()
    got = {(r["id"], r["neighbour"]) for r in near}
    want = brute(rows[::3], 5, 0.9)
    assert len(want) == 20_000 and len(got & want) >= 0.95 * len(want)


def test_copies_and_dirt(spark):
    v = [1.0] + [0.0] * 15
    later = NOW + datetime.timedelta(days=1)
    rows = [("p", f"c{i:03d}", v, NOW, None) for i in range(60)] + [
        ("p", "near", [1.0, 0.1] + [0.0] * 14, NOW, None), ("p", "zero", [0.0] * 16, NOW, None), ("p", "short", [1.0], NOW, None), ("p", "null", None, NOW, None),
        ("p", "old", v, NOW, None), ("p", "old", [0.0, 1.0] + [0.0] * 14, later, None), ("q", "other", v, None, None), (None, "x", v, NOW, None), ("p", None, v, NOW, None),
    ]
    got = K.similar_vectors(spark.createDataFrame(rows, SCHEMA), k=5, least=0.9, dim=16).collect()
    of = lambda i: [r["neighbour"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])]
    assert of("c000") == [f"c{i:03d}" for i in range(1, 6)] and of("c059") == [f"c{i:03d}" for i in range(5)]
    assert of("near") == [f"c{i:03d}" for i in range(5)] and of("old") == of("other") == of("zero") == []
    pairs = K.mutual_pairs(K.similar_vectors(spark.createDataFrame(rows, SCHEMA), k=5, least=0.9, dim=16))
    assert pairs.where("id_a >= id_b").count() == 0
    assert K.similar_vectors(spark.createDataFrame([], SCHEMA), dim=16).count() == 0


def test_hilbert_order_visits_neighbours():
    import itertools

    points = np.array(list(itertools.product(range(8), repeat=3)))
    order = points[np.argsort(K.hilbert_keys(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_keys_order_a_dense_group():
    g = np.random.default_rng(1)
    x = g.normal(size=64)
    x = x / np.linalg.norm(x) + g.normal(size=(20_000, 64)) * np.sqrt(1e-4 / 64)  # cosines of 0.9999
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    some, least = np.arange(0, 20_000, 200), None
    apart = np.stack([((x - x[i]) ** 2).sum(1) for i in some])
    apart[np.arange(len(some)), some] = np.inf
    near = np.argpartition(apart, 5, axis=1)[:, :5]
    for c in range(K.CURVES):
        keys = K.hilbert_keys(K.curve_points(x, c, K.DIRECTIONS, K.BITS), K.BITS, K.BITS // 2)
        place = np.argsort(np.lexsort(keys[::-1]))
        steps = np.abs(place[some][:, None] - place[near])
        least = steps if least is None else np.minimum(least, steps)
    assert (least <= K.WINDOW).mean() > 0.95


RATING = "doc_id long, rater string, reading_level int, rated_at timestamp"


def test_levels_follow_the_grades(spark):
    g = np.random.default_rng(3)
    easy, hard = [f"cat{i}" for i in range(40)], [f"constitution{i}" for i in range(40)]
    docs, ratings, truth = [], [], {}
    for i in range(400):
        level = int(g.integers(1, 6))
        words = [str(g.choice(hard if g.random() < (level - 1) / 4 else easy)) for _ in range(80)]
        size = 3 + 4 * level
        docs.append((i, ". ".join(" ".join(words[k : k + size]) for k in range(0, 80, size)) + ".", "e"))
        truth[i] = level
        if i % 4 == 0:
            ratings += [(i, "r1", level, NOW), (i, "r1", level, NOW), (i, "r2", None, NOW)]
    docs += [(1000, None, "e"), (1001, "", "e"), (1002, "🌱", "e")]
    d = spark.createDataFrame(docs, "doc_id long, text string, e string")
    got = {r["doc_id"]: r for r in reading_levels(d, spark.createDataFrame(ratings, RATING)).collect()}
    held = [i for i in truth if i % 4]
    assert len(got) == 403 and np.mean([got[i]["reading_level"] == truth[i] for i in held]) > 0.8
    assert np.mean([abs(got[i]["difficulty"] - truth[i]) for i in held]) < 0.6
    assert got[1000]["n_words"] == 0 and 1 <= got[1001]["reading_level"] <= 5


def test_levels_without_grades_or_documents(spark):
    d = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], RATING)
    assert [r["reading_level"] for r in reading_levels(d, none).collect()] == [None]
    assert reading_levels(d.limit(0), none).count() == 0


def test_grades(spark):
    rows = [(1, "a", 2, NOW), (1, "a", 3, NOW + datetime.timedelta(1)), (1, "b", 3, NOW), (2, "a", 1, NOW), (3, "a", None, NOW), (None, "a", 1, NOW)]
    got = {r["doc_id"]: (r["grade"], r["certain"]) for r in grades(spark.createDataFrame(rows, RATING)).withColumn("x", F.lit(1)).collect()}
    assert got == {1: (3.0, True), 2: (1.0, False)}
