import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memoriq.llm import pack as P
from memoriq.llm.mix import fit_budget, mixture, shares_report
from memoriq.llm.tokens import DEFAULT_RANKS, with_token_counts

needs_ranks = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no tokenizer files")


def optimum(sizes, capacity):
    best, sizes = len(sizes), sorted(sizes, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + sizes[i] <= capacity}.values():
            bins[k] += sizes[i]
            go(i + 1, bins)
            bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=9))
def test_bins_are_valid_and_optimal(sizes):
    bins = P.complete(sizes, 100)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 100 for b in bins)
    assert P.lower_bound(sizes, 100) <= len(bins) == optimum(sizes, 100)


def test_bound_as_written():
    rng = random.Random(6)
    for _ in range(100):
        sizes, c = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 700))], 100
        best = -(-sum(sizes) // c)
        for k in {0, *(s for s in sizes if 2 * s <= c)}:
            big, mid = [s for s in sizes if s > c - k], [s for s in sizes if c - k >= s and 2 * s > c]
            small = sum(s for s in sizes if k <= s and 2 * s <= c)
            best = max(best, len(big) + len(mid) + max(0, -(-(small - (len(mid) * c - sum(mid))) // c)))
        assert P.lower_bound(sizes, c) == best
    assert P.lower_bound([], 100) == 0


def test_all_undominated_fillings_and_exact_mode():
    got = set(P.fillings(Counter([6, 5, 4, 3, 2, 1]), [6, 5, 4, 3, 2, 1], 7, 7))
    assert got == {(6, 1), (5, 2), (4, 3), (4, 2, 1)}
    rng = random.Random(8)
    for _ in range(30):
        sizes = [rng.randint(18, 60) for _ in range(11)]
        assert len(P.complete(sizes, 100, budget=None)) == optimum(sizes, 100)


def test_later_groups_are_opened():
    rng = random.Random(3)
    sizes = [rng.randint(500, 1100) for _ in range(600)]
    few, many = len(P.complete(sizes, 2048)), len(P.best_fit(sizes, 2048))
    assert few < many - 1


def test_search_improves_best_fit():
    rng, better = random.Random(1), 0
    for _ in range(200):
        sizes = [rng.randint(20, 60) for _ in range(12)]
        better += len(P.complete(sizes, 100)) < len(P.best_fit(sizes, 100))
    assert better > 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 150))
def test_budget_is_met_as_far_as_possible(items, budget):
    lengths, counts = [n for n, _ in items], [c for _, c in items]
    take = fit_budget(lengths, counts, budget)
    reach = {0}
    for n, c in items:
        reach = {r + k * n for r in reach for k in range(c + 1)}
    got = sum(n * t for n, t in zip(lengths, take, strict=True))
    assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
    assert got <= budget
    assert got == max(r for r in reach if r <= budget)


def test_budget_of_many_and_awkward_items():
    assert fit_budget([2, 59], [5, 5], 297) == [1, 5]
    lengths = [14 * k for k in range(3, 90)]  # only multiples of 14 can be met
    for budget in (1, 41, 42, 5_000_011, 123_456_789):
        counts = [40_000] * len(lengths)
        got = sum(n * t for n, t in zip(lengths, fit_budget(lengths, counts, budget), strict=True))
        assert got == (0 if budget < 42 else budget // 14 * 14)
    rng = random.Random(5)
    for _ in range(40):  # few items, so that many sums can't be met
        lengths = rng.sample(range(1, 90), rng.randrange(1, 5))
        counts = [rng.randrange(1, 30) for _ in lengths]
        budget = rng.randrange(sum(n * c for n, c in zip(lengths, counts)) + 1)
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {r + k * n for r in reach for k in range(c + 1)}
        take = fit_budget(lengths, counts, budget)
        assert sum(n * t for n, t in zip(lengths, take)) == max(r for r in reach if r <= budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))


def docs(spark, n=400):
    rng = random.Random(2)
    rows = [(i, rng.choice(["tiny", "", None, "word " * rng.randrange(1, 900), "many words " * 2000 if i % 97 == 0 else "x"]), rng.choice(["A", " a", "b", "c", None]), "q") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")


@needs_ranks
def test_containers(spark):
    d = docs(spark)
    rows = P.assign_containers(d, shard_items=100).collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in with_token_counts(d).collect()}
    used, parts = Counter(), Counter()
    for r in rows:
        assert r["n_tokens"] <= 2048 and (r["container_id"] is None) == (r["n_tokens"] == 0)
        used[r["container_id"]] += r["n_tokens"]
        parts[r["doc_id"]] += r["n_tokens"]
    assert all(v <= 2048 for v in used.values()) and {k: parts[k] for k in sizes} == sizes
    assert all(r["piece_no"] == 0 for r in rows if sizes[r["doc_id"]] <= 2048)
    assert P.packing_report(P.assign_containers(d)).first()["fill"] > 0.95
    assert P.assign_containers(d.limit(0)).count() == 0


@needs_ranks
def test_mixture_shares_and_caps(spark):
    d = docs(spark, 800)
    targets = spark.createDataFrame([("a", 0.5, 1), ("B ", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    mix = mixture(d, targets)
    shares = {r["source"]: r for r in shares_report(mix, targets).collect()}
    assert shares["none"]["tokens"] == 0 and shares["a"]["most_copies"] == 1 and shares["b"]["most_copies"] <= 3
    total = sum(r["tokens"] for r in shares.values())
    assert abs(shares["a"]["tokens"] / total - 0.5 / 0.9) < 0.01 and abs(shares["b"]["tokens"] / total - 0.3 / 0.9) < 0.01
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mixture(d, targets).collect()))
    assert mixture(d, targets, total_tokens=5000).groupBy().sum("n_tokens").first()[0] <= 5000
    assert mixture(d.limit(0), targets).count() == 0
