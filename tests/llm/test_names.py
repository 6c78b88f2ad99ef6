import random

import numpy as np
import pytest

from memoriq.llm import names as N

SCHEMA = "id string, canonical_name string, aliases array<string>, entity string"


def groups(spark, rows, short=None):
    df = spark.createDataFrame([(f"{i:02d}", *r, None) if isinstance(r, tuple) else (f"{i:02d}", r, None, None) for i, r in enumerate(rows)], SCHEMA)
    out = {}
    for r in N.link_names(df, short).collect():
        out.setdefault(r["entity"], set()).add(rows[int(r["id"])][0] if isinstance(rows[int(r["id"])], tuple) else rows[int(r["id"])])
    return {frozenset(v) for v in out.values()}


def test_variants_are_linked_and_relatives_are_not(spark):
    short = spark.createDataFrame([("Robert", "Bob")], "formal_name string, short_form string")
    one = {"Robert Kolibrandt", "Kolibrandt, Robert", "Dr. Robert Kolibrandt", "ROBERT KOLIBRANDT", "RobertKolibrandt", "Robert Kolibrnadt", "Bob Kolibrandt", "R. Kolibrandt", "Robert Kolib."}
    two = {"Helena Kolibrandt", "Helena T. Kolibrandt"}
    three = {"Lake Mavopuhill", "L. Mavopuhill", "Mavopuhill Lake", "lake mavopuhill"}
    four = {"Zetolawo Robotics, Inc.", "The Zetolawo Robotics Company", "zetolawo-robotics", "Zetolawo Robot.", "Robotics Zetolawo"}
    five = {"Zetolawo Bakery"}
    got = groups(spark, sorted(one | two | three | four | five), short)
    assert got == {frozenset(x) for x in (one, two, three, four, five)}


def test_an_initial_that_fits_two_people_stays_alone(spark):
    got = groups(spark, ["Anna Pelmoritz", "Alban Pelmoritz", "A. Pelmoritz", "Alban Pelmoritz"])
    assert frozenset({"A. Pelmoritz"}) in got and frozenset({"Alban Pelmoritz"}) in got


def test_aliases_and_codes(spark):
    got = groups(spark, [("KV-77", ["Greta Vosamilund"]), ("Greta Vosamilund", None), ("Vosamilund, Greta", []), ("KV-78", None), ("KV-78", None)])
    assert got == {frozenset({"KV-77", "Greta Vosamilund", "Vosamilund, Greta"}), frozenset({"KV-78"})}


def test_nulls_empty_and_clashing_rows(spark):
    df = spark.createDataFrame([("a", None, None, "x"), ("b", "", [None], "x"), ("c", "🌱", None, "x"), (None, "Ann Belloro", None, "x"), ("d", "x" * 3000, None, "x"), ("d", "x" * 3000, None, "x")], SCHEMA)
    assert sorted((r["id"], r["entity"]) for r in N.link_names(df).collect()) == [(i, i) for i in "abcd"]
    assert N.link_names(df.limit(0)).count() == 0


def osa(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def typos(rng, word, k):
    w = list(word)
    for _ in range(k):
        at = rng.randrange(len(w))
        kind = rng.randrange(4)
        if kind == 0:
            w[at] = rng.choice("abc")
        elif kind == 1:
            w.insert(at, rng.choice("abc"))
        elif kind == 2 and len(w) > 2:
            del w[at]
        elif at + 1 < len(w):
            w[at], w[at + 1] = w[at + 1], w[at]
    return "".join(w)


def some_words(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 14))) for _ in range(60)] + ["abc" * 13, "abc" * 14]
    return sorted({typos(rng, w, k) for w in base for k in (0, 1, 2, 2)})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_automata_list_all_neighbours(seed):
    words = some_words(seed)
    shard = np.sort(np.random.default_rng(seed).integers(0, 3, len(words)))
    got = {frozenset((i, j)) for i, j in N.neighbours(shard, words)}
    want = {
        frozenset((i, j)) for i in range(len(words)) for j in range(i)
        if shard[i] == shard[j] and osa(words[i], words[j]) <= N.bound_for(min(len(words[i]), len(words[j])))
    }
    assert got == want and want


def test_trie_join_finds_every_pair(spark):
    words = sorted({w for seed in (1, 2, 3) for w in some_words(seed)} | {"wolf", "wofl", "klein", "klin", "johanna", "ojhanna", "kolibrandt", "oklibrandth"})
    short = {"abc": True, "bca": True}
    df = spark.createDataFrame([(w, short.get(w, False)) for w in {*words, *short}], "word string, abbreviated boolean")
    got = {(r["a"], r["b"]) for r in N.trie_join(df).collect()}
    full = [w for w in words if w not in short]
    want = {(x, y) for x in full for y in full if x == y or (abs(len(x) - len(y)) < 3 and osa(x, y) <= N.bound_for(min(len(x), len(y))))}
    want |= {p for s in short for x in full if x.startswith(s) for p in ((s, x), (x, s))} | {(s, s) for s in short}
    assert got == want


def test_any_number_of_tokens(spark):
    seven = "Alfa Bravol Charlie Deltan Echona Foxtrot Golfar"
    rows = [seven, "Golfar Foxtrot Echona Deltan Charlie Bravol Alfa", seven.replace("Charlie", "Chralie"), "Alfa Bravol Charlie Deltan Echona Foxtrot Hotel"]
    assert groups(spark, rows) == {frozenset(rows[:3]), frozenset(rows[3:])}
    twenty = [(f"t{i}x", "i" if i % 3 else "w", []) for i in range(20)]
    assert N.agree(twenty, twenty[::-1]) == 2


def test_size_of_the_table_changes_no_link(spark):
    rng = random.Random(4)
    pairs = [("Johanna Wolf", "Johanna Wofl"), ("Ojhanna Bergmann", "Johanna Bergmann"), ("Peter Kolibrandt", "Peter Kloibrantd")]
    small = [n for p in pairs for n in p]
    crowd = [f"Johanna {''.join(rng.choice('bdgklmnprst') + rng.choice('aeiou') for _ in range(5)).capitalize()}" for _ in range(60)]
    crowd += [f"{g} {s}" for g in ("Ulrike", "Dominik", "Valentin", "Susanne") for s in ("Wolf", "Bergmann")]
    for rows in (small, small + crowd):
        got = groups(spark, rows)
        assert all(any(set(p) <= g for g in got) for p in pairs)


def test_parse():
    assert N.parse("Saint-Malo") == N.parse("St. Malo") == [("saint", "w"), ("malo", "w")]
    assert N.parse("Müller GmbH & Co. KG") == [("muller", "w")]
    assert N.parse("AC Fanelund") == [("ac", "i"), ("fanelund", "w")] and N.parse("Fanelund, A.") == [("a", "i"), ("fanelund", "w")]


def test_candidates_come_in_parts_that_the_driver_can_plan(spark):
    token = lambda pos, t: {"pos": pos, "t": t, "k": "w", "n": 1, "o": []}
    schema = "fid long, x array<struct<pos:int,t:string,k:string,n:long,o:array<string>>>"
    full = spark.createDataFrame([(1, [token(0, "robert"), token(1, "kolib")]), (2, [token(0, "kolib"), token(1, "robert")]), (3, [token(0, "anna"), token(1, "kolib")])], schema)
    alike = spark.createDataFrame([(w, w) for w in ("robert", "kolib", "anna")], "a string, b string")
    out = N.candidate_forms(full, alike)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(1, 2)]
