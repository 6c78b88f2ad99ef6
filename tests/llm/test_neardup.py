import random

import pytest
from pyspark.sql import functions as F

from memoriq.llm import neardup as N
from memoriq.llm.components import components

SCHEMA = "id string, text string, source string, node string"


def jaccard(a, b, width):
    grams = lambda t: {tuple(w[i : i + width]) for w in [N.words_of(t)] for i in range(len(w) - width + 1)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.choice((14, 20, 60, 400)))]
        out.append((f"t{i:03d}", " ".join(base)))
        for k in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            out.append((f"t{i:03d}.{k}", " ".join(copy) + rng.choice(("", "!", " "))))
    return out


def pairs(spark, rows, width, threshold, min_words=0):
    df = spark.createDataFrame([(i, t, None, "x") for i, t in rows], SCHEMA)
    return {(r["id_a"], r["id_b"]) for r in N.all_pairs(*N.near_duplicates(df, width, threshold, min_words)).collect()}


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.5), (5, 0.8), (1, 0.3)])
def test_matches_brute_force(spark, width, threshold):
    rows = corpus(60)
    want = {(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y, width) >= threshold}
    assert pairs(spark, rows, width, threshold) == want and (width == 1 or want)


def test_nulls_short_long_and_repeated(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [("a", None), ("b", ""), ("c", "one two"), (None, long), ("d", long), ("d", long), ("e", long + " end"), ("f", long), ("g", "🌱 " * 50)]
    assert pairs(spark, rows, 3, 0.5) == {("d", "e"), ("d", "f"), ("e", "f")}
    assert pairs(spark, [], 3, 0.5) == set()


def found_pairs(spark, rows, chunk=N.CHUNK, range_size=N.RANGE, **k):
    df = spark.createDataFrame(rows, "id string, text string")
    sets = N.counted(N.written(N.shingle_chunks(df, 3, 0, chunk), "c"), range_size)
    ids = {n: i for r in sets.collect() for i, n in zip(r["ids"], r["nodes"])}
    return {tuple(sorted((ids[r["u"]], ids[r["v"]]))) for r in N.similar_sets(sets, 0.5, **k).collect()}


def test_hot_shingles_are_spread_and_lose_nothing(spark):
    rows = [(f"h{i:03d}", " ".join(["same words in every one of the rows here"] * 2 + [f"tail{i % 7}", f"z{i}"])) for i in range(90)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y, 3) >= 0.5}
    for shard_rows in (5, 10, 2048):
        assert found_pairs(spark, rows, shard_rows=shard_rows) == want


def test_small_chunks_and_ranges_change_nothing(spark):
    import numpy as np

    rows = corpus(40)
    want = found_pairs(spark, rows)
    assert want and found_pairs(spark, rows, chunk=50, range_size=64) == want
    df = spark.createDataFrame(rows, "id string, text string").coalesce(1)
    placed = []
    for chunk, range_size in ((N.CHUNK, N.RANGE), (60, 100)):
        got = {}
        for r in N.counted(N.written(N.shingle_chunks(df, 3, 0, chunk), "c"), range_size).collect():
            h, c = np.frombuffer(r["shingles"], np.uint32), np.frombuffer(r["codes"], np.uint8)
            ends = np.cumsum(r["sizes"])
            got |= {n: (h[e - k : e].tolist(), c[e - k : e].tolist()) for n, k, e in zip(r["own"], r["sizes"], ends)}
        placed.append(got)
    assert placed[0] == placed[1]  # the same sets, shingles and numbers, so the same rows are sent
    from collections import Counter

    times = Counter(x for h, _ in placed[0].values() for x in h)
    assert all(times[x] == k for h, c in placed[0].values() for x, k in zip(h, c) if times[x] <= 64)


def test_trees_find_all_within_radius():
    import numpy as np

    g = np.random.default_rng(3)
    base = g.integers(0, 2**63, (40, 4)).astype(np.uint64)
    keys = np.concatenate([base, base[:20] ^ (np.uint64(1) << g.integers(0, 63, (20, 4)).astype(np.uint64)), base[:10]])
    group = np.sort(g.integers(0, 5, len(keys)))
    radius = g.integers(0, 140, len(keys))
    trees = N.Trees(group, keys)
    assert len(trees.child)  # nodes hang below roots
    i, j, d = trees.pairs(radius)
    dist = np.bitwise_count(keys[:, None] ^ keys[None]).sum(2)
    want = {(a, b) for b in range(len(keys)) for a in range(b) if group[a] == group[b] and dist[a, b] <= radius[b]}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want and (dist[i, j] == d).all()
    assert N.Trees(group[:0], keys[:0]).pairs(radius[:0])[0].size == 0


def test_parity_bounds_the_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (set(rng.integers(0, 2**32, rng.integers(1, 300)).tolist()) for _ in "ab")
        b |= set(list(a)[: len(a) // 2])
        mark = lambda s: int.from_bytes(np.packbits(np.bincount([x & 255 for x in s], minlength=256) & 1))
        assert (mark(a) ^ mark(b)).bit_count() <= len(a ^ b)


def test_groups(spark):
    rows = [("a", "one two three four five six seven eight nine ten eleven"), ("b", "one two three four five six seven eight nine ten eleven"), ("c", "zero one two three four five six seven eight nine ten eleven"), ("d", "x"), ("e", "x."), ("f", "y")]
    got = {r["id"]: (r["group_id"], r["n_members"], r["n_links"]) for r in N.duplicate_groups(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"a": ("a", 3, 1), "b": ("a", 3, 1), "c": ("a", 3, 1), "d": ("d", 2, 0), "e": ("d", 2, 0), "f": ("f", 1, 0)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_extra_columns_may_clash(spark):
    df = spark.createDataFrame(corpus(5), "id string, text string")
    more = df.withColumns({c: F.lit(1) for c in ("u", "v", "shard", "component", "group_id")})
    assert N.duplicate_groups(more).count() == df.count()
