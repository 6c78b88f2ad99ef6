import random

from memoriq.llm.split import split_oversized, split_text


def check(text, limit, overlap):
    parts = split_text(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in parts) == text
    for k, (s, b, e) in enumerate(parts):
        assert e - s <= limit and s <= b <= e and (len(parts) == 1 or e > b)
        assert k == 0 or (b == parts[k - 1][2] and b - s <= overlap)
    return parts


def test_round_trip_on_many_texts():
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "end. ", "\n", "\n\n", "# head\n", "```\ncode, a. b\n```\n", "🌱", "👍🏽", "é", ", "]) for _ in range(rng.randrange(0, 800)))
        check(text, rng.choice((40, 200, 1800)), rng.choice((0, 10, 39)))


def test_cuts_at_the_strongest_boundary_near_the_middle():
    text = "a" * 700 + ". " + "b" * 200 + "\n\n" + "c" * 900 + " " + "d" * 400
    parts = check(text, 1800, 200)
    assert [b for _, b, _ in parts] == [0, 904]


def test_no_boundary_and_very_long():
    assert len(check("x" * 5000, 1800, 200)) == 4
    parts = check("lorem ipsum dolor. " * 60_000, 1800, 200)
    assert all(150 <= b - s <= 200 for s, b, _ in parts[1:])


def test_joined_characters_stay_whole():
    text = "👩‍🚀" * 1500
    for s, b, e in check(text, 1800, 200):
        assert text[b : b + 1] != "‍" and text[b - 1 : b] != "‍" and text[s : s + 1] != "‍"


def test_operator_nulls_empty_repeats(spark):
    rows = [("a", None, 1), ("b", "", 2), ("c", "x " * 1000, 3), ("c", "x " * 1000, 3), (None, "y", 4)]
    got = split_oversized(spark.createDataFrame(rows, "id string, text string, piece int")).collect()
    assert sorted((r["id"] or "", r["n_pieces"]) for r in got) == [("", 1), ("b", 1), ("c", 2), ("c", 2), ("c", 2), ("c", 2)]
    assert split_oversized(spark.createDataFrame([], "id string, text string")).count() == 0
