"""Link the spellings of a person's, organisation's or place's name.

Spellings become forms: lower-case tokens without accents, titles, articles and
legal suffixes, each a word, an initial, an abbreviation or a code. Work is done on
distinct forms, so an entity of very many rows costs as many comparisons as it
has spellings.

1. Trie join: all distinct words are sharded into tries by pieces that two
   neighbours must share. The tries of many shards are walked together, level by
   level, by the Levenshtein automata of all their words (a state is the band of
   edit distances around the diagonal, transpositions included), which lists all
   neighbours within the bound; abbreviations list the words they begin. Other
   names of a name (nicknames) are neighbours too.
2. Forms that share two neighbouring words, or one and an initial, are checked
   over all token orders: every token of the shorter form needs a counterpart (the
   same within an edit, a nickname, an abbreviation, an initial), what is left over
   may only be initials. How a pair of words finds its partners (by either word, or
   by both at once) is chosen by the number of rows each way would meet; what is
   found is the same.
3. Agreements on two words are links; their components are entities. A form that
   has only initials beside its word joins an entity if just one fits.

Nicknames come from a table of short forms and from rows whose aliases use them.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memoriq.llm.components import components
from memoriq.llm.neardup import _ranges, whole_groups
from memoriq.session import written

TITLES = set("dr prof mr mrs ms miss sir dame herr frau hr fr don dona señor senor senora sra".split())
LEGAL = set("inc incorporated llc ltd limited plc corp corporation company co gmbh ag kg se sl sa srl bv nv".split())
ARTICLES = set("the of town city village la el los las le der die das von de del du".split())
SAME = {"st": "saint", "mt": "mount", "mtn": "mount", "ft": "fort", "coop": "cooperative"}
_SPLIT = re.compile(r"[^\W_]+(?:['’][^\W_]+)*\.?")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in text if not unicodedata.combining(c))


def parse(spelling: str) -> list[tuple[str, str]]:
    """Tokens as (text, kind): w word, p abbreviation, i initials (in order), c code. Given part first if a comma tells."""
    text = fold(spelling).strip()
    text = re.sub(r"\bS\.\s?(?:L|A|R\.\s?L)\.?(?=\W|$)", " ", text)
    text = re.sub(r"(?i)\bco-op\b\.?", "cooperative", text)
    text = re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z])", " ", text)
    parts = [p.strip() for p in text.split(",") if p.strip()]
    parts = [p for p in parts if p.lower().rstrip(".") not in LEGAL] or parts
    if len(parts) == 2:
        parts.reverse()
    out = []
    for raw in _SPLIT.findall(" ".join(parts)):
        word, low = raw.rstrip("."), raw.rstrip(".").lower().replace("’", "'")
        if low in TITLES or low in LEGAL or low in ARTICLES:
            continue
        low = SAME.get(low, low)
        if any(c.isdigit() for c in low):
            out.append((low, "c"))
        elif len(low) == 1 or (len(low) == 2 and word.isupper() and not text.isupper()):
            out.append((low, "i"))
        elif raw.endswith(".") and low not in SAME.values():
            out.append((low, "p"))
        else:
            out.append((low, "w"))
    return out


def distance(a: str, b: str, bound: int) -> int:
    """Edit distance with adjacent transpositions, or bound + 1 if it is more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and x == b[j - 2] and j > 1 and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > bound:
            return bound + 1
        before, row = row, new
    return min(row[-1], bound + 1)


def bound_for(n: int) -> int:
    """Edits allowed between words whose shorter has n letters."""
    return 0 if n < 4 else 1 if n < 8 else 2


#: Letters up to which words are walked in arrays; longer ones are compared one by one, in the same shards.
LONGEST = 40


def neighbours(shard, words: list[str]) -> list[tuple[int, int]]:
    """Pairs (row, row) of unequal words of one shard within the bound of the shorter. Rows of a shard are adjacent; no word stands twice in it."""
    import numpy as np

    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    out = _walk(np.flatnonzero(size <= LONGEST), shard, words, size)
    long = np.flatnonzero(size > LONGEST - 2).tolist()
    for k, i in enumerate(long):
        for j in itertools.takewhile(lambda j, i=i: shard[j] == shard[i], long[k + 1 :]):
            if max(size[i], size[j]) > LONGEST and distance(words[i], words[j], 2) <= 2:
                out.append((i, j))
    return out


def _walk(rows, shard, words: list[str], size) -> list[tuple[int, int]]:
    import numpy as np

    if not len(rows):
        return []
    width = int(size[rows].max())
    letters = np.array([words[i] for i in rows], f"U{width}").view(np.uint32).reshape(len(rows), width)
    order = np.lexsort([*letters.T[::-1], shard[rows]])
    rows, letters = rows[order], letters[order]
    n, home = size[rows], shard[rows]
    bound = np.where(n < 4, 0, np.where(n < 8, 1, 2))
    letters = np.hstack([letters, np.zeros((len(rows), 4), np.uint32)])
    # nodes of a depth are runs of words with one beginning: their first words
    new = np.r_[True, home[1:] != home[:-1]]
    firsts = np.flatnonzero(new)
    query = np.arange(len(rows))
    node = np.cumsum(new) - 1
    far = 9
    row = np.full((len(rows), 6), far, np.int8)  # distances of the node's letters to the first depth + t - 2 of the query's; a column more
    row[:, 2:5] = [0, 1, 2]
    before, last = np.full_like(row, far), np.zeros(len(rows), np.uint32)
    found = []
    for depth in range(width):
        # children: runs at the next depth, without the words that end here
        new = new | np.r_[True, letters[1:, depth] != letters[:-1, depth]]
        starts = np.flatnonzero(new & (letters[:, depth] != 0))
        low = np.searchsorted(starts, firsts)
        high = np.searchsorted(starts, np.r_[firsts[1:], len(rows)])
        who, child = _ranges(low[node], high[node])
        query, up, upper, prior = query[who], row[who], before[who], last[who]
        c = letters[starts[child], depth]
        row = np.full_like(up, far)
        for t in range(5):
            j = depth + 1 + t - 2
            if j < 0:
                continue
            best = up[:, t + 1] + 1
            if t:
                best = np.minimum(best, row[:, t - 1] + 1)
            if j:
                mine = letters[query, j - 1]
                best = np.minimum(best, up[:, t] + (c != mine))
                if j > 1 and depth:
                    swapped = (c == letters[query, j - 2]) & (prior == mine)
                    best = np.where(swapped, np.minimum(best, upper[:, t] + 1), best)
            row[:, t] = np.where(j > n[query], far, np.minimum(best, far))
        keep = row[:, :5].min(1) <= bound[query]
        query, child, c, row, before = query[keep], child[keep], c[keep], row[keep], up[keep]
        last = c
        firsts, node = starts, child
        # a word that ends at a node is its first one
        end = starts[child]
        t = n[query] - (depth + 1) + 2
        done = (n[end] == depth + 1) & (t >= 0) & (t < 5)
        q, e = query[done], end[done]
        d = row[done, t[done]]
        ok = (q != e) & (d <= np.minimum(bound[q], bound[e]))
        found.append(np.stack([rows[q[ok]], rows[e[ok]]], 1))
    return [tuple(x) for x in np.concatenate(found).tolist()]


def shards_of(word: str) -> list[str]:
    """Pieces of a word; neighbours share one.

    One edit (or transposition) leaves the first two or the last two letters as
    they are, of four letters at least the outer ones. Two edits, which words of
    eight letters or more may have, can touch both ends; then the letters from the
    fourth to the last but three stay, moved by at most one place.
    """
    n = len(word)
    if n < 4:
        return []
    out = {"<" + word[:2], ">" + word[-2:]}
    if n == 4:
        out.add("^" + word[0] + word[-1])
    for piece in ([2] if 8 <= n <= 10 else []) + ([3] if n >= 9 else []):
        out |= {"|" + word[k : k + piece] for k in (2, 3, 4)}
    return sorted(out)


def trie_join(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct `words` (word, abbreviated) that are neighbours, each pair both ways, and each word with itself.

    Words of fewer than four letters equal only themselves; an abbreviation of
    three letters or more is a neighbour of every word it begins.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, short in zip(b["word"], b["abbreviated"], strict=True):
                out += [("<" + w[:2], w, True)] if short and len(w) >= 3 else [(k, w, False) for k in shards_of(w)] if not short else []
                if not short and len(w) == 3:
                    out.append(("<" + w[:2], w, False))  # an abbreviation may be all of it
            yield pd.DataFrame(out, columns=["shard", "word", "abbreviated"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bisect

        for b in whole_groups(batches, "shard", 20_000):
            full = b[~b["abbreviated"]]
            # words that share their end are walked from there
            turned = full["shard"].str.startswith(">")
            pairs = []
            for part, back in ((full[~turned], False), (full[turned], True)):
                ws = part["word"].tolist()
                keys = pd.factorize(part["shard"])[0]
                pairs += [(ws[i], ws[j]) for i, j in neighbours(keys, [w[::-1] for w in ws] if back else ws)]
            short = b[b["abbreviated"]]
            if len(short):
                groups = {k: sorted(g["word"]) for k, g in full[full["shard"].isin(set(short["shard"]))].groupby("shard")}
                for k, w in zip(short["shard"], short["word"], strict=True):
                    g = groups.get(k, [])
                    for x in itertools.takewhile(lambda x, w=w: x.startswith(w), g[bisect.bisect_left(g, w) :]):
                        pairs.append((w, x))
            yield pd.DataFrame([*pairs, *((y, x) for x, y in pairs)], columns=["a", "b"])

    cores = words.sparkSession.sparkContext.defaultParallelism
    keyed = words.mapInPandas(spread, "shard string, word string, abbreviated boolean")
    # small in bytes, heavy in time: partitions of its own number aren't merged
    parts = max(2 * cores, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = keyed.repartition(parts, "shard").sortWithinPartitions("shard").mapInPandas(join, "a string, b string")
    return found.unionByName(words.select(F.col("word").alias("a"), F.col("word").alias("b"))).distinct()


def _match(x: tuple, y: tuple) -> tuple[int, int, int] | None:
    """(edits, words, initials) of two tokens that can be the same, or None."""
    (x, kx, ax), (y, ky, ay) = x, y
    if kx == "i" or ky == "i":
        if kx == ky:
            ok = x == y or (len(x) != len(y) and x[0] == y[0])
        else:
            short, (full, others) = (x, (y, ay)) if kx == "i" else (y, (x, ax))
            ok = short[0] == full[0] or any(o[0] == short[0] for o in others)
        return (0, 0, 1) if ok else None
    if x == y or y in ax or x in ay or (set(ax) & set(ay)):
        return (0, 1, 0)
    if kx == "p" or ky == "p":
        short, full = (x, y) if kx == "p" else (y, x)
        return (0, 1, 0) if full.startswith(short) else None
    if ax and ay:  # two names that are known are two names, however similar
        return None
    # a mistyped name is near the other, or near another name of it
    d = min(distance(p, q, 2) for p, q in ((x, y), *((x, o) for o in ay), *((o, y) for o in ax)))
    if d > bound_for(min(len(x), len(y))) or (d == 2 and x[0] != y[0]):
        return None
    return (d, 1, 0)


def agree(a: list, b: list) -> int:
    """2 if two forms agree on at least two words (or are one word each), 1 if on one word and initials, else 0.

    A form is a list of (text, kind, other names), of any length. Every token of the
    shorter form gets a counterpart of its own, in any order; tokens with few
    counterparts choose first.
    """
    if len(a) > len(b):
        a, b = b, a
    ways = [{j: m for j, y in enumerate(b) if (m := _match(x, y))} for x in a]
    full = [j for j, t in enumerate(b) if t[1] != "i"]
    if not all(ways) or any(all(j not in w for w in ways) for j in full):
        return 0
    # a second initial on one side must be the middle initial of the other
    middles = [{t[1:] for t, k, _ in f if k == "i" and len(t) > 1} | {t for t, k, _ in f if k == "i" and len(t) == 1} for f in (a, b)]
    apart = bool(middles[0] and middles[1] and not middles[0] & middles[1])
    ways.sort(key=len)
    best, seen = 0, set()

    def go(i: int, used: int, edits: int, words: int, initials: int) -> None:
        nonlocal best
        state = (i, used, edits, min(words, 2), min(initials, 1))
        if best == 2 or edits > 2 or state in seen:
            return
        seen.add(state)
        if i == len(ways):
            if all(used >> j & 1 for j in full):
                if not apart and (words >= 2 or (words == 1 and len(b) == 1)):
                    best = 2
                elif words == 1 and initials:
                    best = max(best, 1)
            return
        for j, (d, w, k) in ways[i].items():
            if not used >> j & 1:
                go(i + 1, used | 1 << j, edits + d, words + w, initials + k)

    go(0, 0, 0, 0, 0)
    return best


_FORMS = "id string, form string, tokens array<struct<t:string,k:string>>, own array<string>"


def spelled_forms(rows: DataFrame) -> DataFrame:
    """(id, form, tokens, own): one row per spelling that has a word; `own` are nickname pairs seen in the row, 'a b'."""

    def nicknames(forms: list) -> set[str]:
        found = set()
        plain = [[t for t, k in f if k == "w"] for f in forms]
        for f, g in itertools.combinations([p for p in plain if len(p) == 2], 2):
            for (x, s), (y, r) in itertools.product((f, f[::-1]), (g, g[::-1])):
                same = len(s) > 4 and distance(s, r, 1) <= 1
                if same and min(len(x), len(y)) >= 2 and distance(x, y, 2) > bound_for(min(len(x), len(y))):
                    if len(x) <= 10 and len(y) <= 10 and x not in (s, r) and y not in (s, r):
                        found |= {f"{x} {y}", f"{y} {x}"}
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, name, aliases in zip(b["id"], b["canonical_name"], b["aliases"], strict=True):
                spellings = [name, *(aliases if aliases is not None else [])]
                forms = [f for f in (parse(s) for s in spellings if s) if any(k in "wp" for _, k in f)]
                own = sorted(nicknames(forms))
                if not forms and name:  # a code or initials: comparable as a whole only
                    forms = [[("=" + fold(name).lower().strip(), "w")]]
                for f in {" ".join(t + "/" + k for t, k in f): f for f in forms}.values():
                    out.append((i, " ".join(t + "/" + k for t, k in f), [{"t": t, "k": k} for t, k in f], own))
            yield pd.DataFrame(out, columns=["id", "form", "tokens", "own"])

    return rows.mapInPandas(run, _FORMS)


def nicknames_of(spelled: DataFrame, bare: DataFrame, short_forms: DataFrame | None, share: float = 0.4) -> DataFrame:
    """(t, other): other names of a name, from the table, from rows whose aliases use them, and from use.

    Two words with one initial are taken for the same name if they stand beside at
    least two, and `share` of the rarer one's, rarer words together: surnames meet by
    chance far more seldom.
    """
    nick = spelled.select(F.explode("own").alias("o")).select(F.split("o", " ").alias("o")).select(F.col("o")[0].alias("t"), F.col("o")[1].alias("other"))
    if short_forms is not None:
        simple = F.pandas_udf(lambda s: s.map(lambda x: fold(x).lower() if x else None), "string")
        table = short_forms.select(simple("formal_name").alias("t"), simple("short_form").alias("other")).dropna()
        nick = nick.unionByName(table).unionByName(table.select(F.col("other").alias("t"), F.col("t").alias("other")))
    wordy = F.filter("x", lambda t: t["k"].isin("w", "p") & (F.length(t["t"]) >= 3))
    beside = bare.select("x", F.explode(wordy).alias("a")).select(
        F.col("a.t").alias("anchor"), F.col("a.n").alias("partners"), F.filter("x", lambda t: (t["k"] == "w") & (t["pos"] != F.col("a.pos"))).alias("rest")
    )
    # a given name has more partners than a surname: only that way round
    beside = beside.where((F.size("rest") == 1) & (F.get("rest", F.lit(0))["n"] > F.col("partners")))
    beside = beside.select("anchor", F.get("rest", F.lit(0))["t"].alias("t")).distinct()
    total = beside.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    beside = beside.join(total, "t").withColumn("initial", F.substring("t", 1, 1))
    x, y = beside.toDF("t", "anchor", "n", "initial"), beside.toDF("other", "anchor", "n2", "initial")
    met = x.join(y, ["anchor", "initial"]).where(F.col("t") != F.col("other"))
    met = met.groupBy("t", "other").agg(F.count(F.lit(1)).alias("s"), F.least(F.first("n"), F.first("n2")).alias("least"))
    return nick.unionByName(met.where((F.col("s") >= 2) & (F.col("s") >= F.col("least") * share)).select("t", "other")).distinct()


def candidate_forms(full: DataFrame, alike: DataFrame) -> DataFrame:
    """Pairs (f, g), f < g, of forms that share two neighbouring words, or one with an initial, or are one word each.

    `full` has fid and x (tokens), `alike` all neighbouring words (a, b). Agreements
    have one of these: two words, one word and an initial of the form that has no
    other word, or one word and an initial each way.
    """
    wordy = lambda x: F.filter(x, lambda t: t["k"] != "i")
    forms = full.select("fid", "x", wordy("x").alias("w"))
    two = forms.where(F.size("w") > 1).select("fid", F.explode("w").alias("p"), "w").select("fid", "p", F.explode("w").alias("q")).where(F.col("p.pos") != F.col("q.pos"))
    both = written(two.select("fid", F.col("p.t").alias("a"), F.col("q.t").alias("b")).distinct(), "name-both")
    pairs = written(both.select("a", "b").distinct(), "name-beside")
    # how many rows each way of finding partners would meet
    met = pairs.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cost = alike.join(met, "b", "left").groupBy("a").agg(F.count(F.lit(1)).alias("ways"), F.coalesce(F.sum("n"), F.lit(0)).alias("cost"))
    one = pairs.where("a <= b").join(cost.toDF("a", "wa", "ca"), "a").join(cost.toDF("b", "wb", "cb"), "b")
    double = F.col("wa") * F.col("wb")
    one = written(
        one.select(
            "a", "b", F.when(double < F.least("ca", "cb"), "both").when(F.col("ca") <= F.col("cb"), "a").otherwise("b").alias("way")
        ),
        "name-pairs",
    )
    # c, d are the partner's words, c like a and d like b
    to_a, to_b = alike.toDF("a", "c"), alike.toDF("b", "d")
    other = pairs.toDF("c", "d")
    found = [
        one.where("way = 'a'").join(to_a, "a").join(other, "c").join(to_b, ["b", "d"]),
        one.where("way = 'b'").join(to_b, "b").join(other, "d").join(to_a, ["a", "c"]),
        one.where("way = 'both'").join(to_a, "a").join(to_b, "b").join(other, ["c", "d"]),
    ]
    # each way is a plan of its own: one of them all has some forty joins, which the driver keeps and broadcasts at once
    found = [written(x.select("a", "b", "c", "d"), "name-ways") for x in found]
    left, right = both.toDF("f", "a", "b"), both.toDF("g", "c", "d")
    out = [reduce(DataFrame.unionByName, found).join(left, ["a", "b"]).join(right, ["c", "d"]).select("f", "g")]
    # a word and an initial (or a short abbreviation)
    initials = lambda t: (t["k"] == "i") | ((t["k"] == "p") & (F.length(t["t"]) < 3))
    sides = forms.select("fid", "x", "w", F.explode("w").alias("p")).withColumn("rest", F.filter("x", lambda t: t["pos"] != F.col("p.pos")))
    first = lambda t: F.substring(t["t"], 1, 1)
    letters = lambda x: F.array_distinct(F.flatten(F.transform(x, lambda t: F.concat(F.array(first(t)), F.transform(t["o"], lambda o: F.substring(o, 1, 1))))))
    says = F.array_distinct(F.transform(F.filter("rest", initials), first))
    short = sides.select("fid", F.col("p.t").alias("a"), (F.size(F.filter("rest", lambda t: ~initials(t))) == 0).alias("alone"), says.alias("says"), letters("rest").alias("rest"), letters(F.filter("rest", lambda t: t["k"] != "i")).alias("full"))
    asks = short.where("alone").select(F.col("fid").alias("f"), "a", F.explode("says").alias("letter"))
    has = short.select(F.col("fid").alias("g"), F.col("a").alias("b"), F.explode("rest").alias("letter"))
    out.append(asks.join(alike, "a").join(has, ["b", "letter"]).select("f", "g"))
    mixed = short.where(~F.col("alone") & (F.size("says") > 0)).select("fid", "a", F.explode("says").alias("i"), "full").select("fid", "a", "i", F.explode("full").alias("l"))
    out.append(mixed.toDF("f", "a", "i", "l").join(alike, "a").join(mixed.toDF("g", "b", "l", "i"), ["b", "l", "i"]).select("f", "g"))
    # one word each
    single = forms.where((F.size("x") == 1) & (F.size("w") == 1)).select("fid", F.get("w", F.lit(0))["t"].alias("a"))
    out.append(single.toDF("f", "a").join(alike, "a").join(single.toDF("g", "b"), "b").select("f", "g"))
    out = reduce(DataFrame.unionByName, [written(x, "name-candidates") for x in out])
    return out.where("f != g").select(F.least("f", "g").alias("f"), F.greatest("f", "g").alias("g")).distinct()


def link_names(entities: DataFrame, short_forms: DataFrame | None = None) -> DataFrame:
    """(id, entity): rows that stand for the same one share `entity`, the least id among them.

    `entities` needs id, canonical_name and aliases (array, null allowed);
    `short_forms` formal_name and short_form. Rows without a name, and names that
    match no other, are entities of their own. Repeated rows of an id count once.
    """
    rows = entities.select("id", "canonical_name", "aliases").where(F.col("id").isNotNull())
    spelled = written(spelled_forms(rows), "name-forms")
    forms = spelled.groupBy("form").agg(F.any_value("tokens").alias("tokens")).withColumn("fid", F.xxhash64("form"))
    token = forms.select("fid", "form", F.posexplode("tokens").alias("pos", "x")).select("fid", "pos", "x.t", "x.k")
    # partners of a word: how many different words it stands beside
    sides = token.where("k IN ('w', 'p')")
    beside = sides.join(sides.select("fid", F.col("pos").alias("pos2"), F.col("t").alias("t2")), "fid").where("pos != pos2")
    partners = beside.groupBy("t").agg(F.countDistinct("t2").alias("partners"))
    plain = token.join(partners, "t", "left").select("fid", "pos", "t", "k", F.coalesce("partners", F.lit(0)).alias("n"))
    bare = written(plain.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("pos", "t", "k", "n"))).alias("x")), "name-words")
    nick = written(nicknames_of(spelled, bare, short_forms), "name-nicknames")
    others = bare.select("fid", F.explode("x").alias("x")).select("fid", "x.t").distinct().join(nick.groupBy("t").agg(F.collect_set("other").alias("others")), "t")
    others = others.groupBy("fid").agg(F.map_from_entries(F.collect_list(F.struct("t", "others"))).alias("others"))
    named = F.transform(
        "x",
        lambda t: F.struct(
            t["pos"].alias("pos"), t["t"].alias("t"), t["k"].alias("k"), F.coalesce(F.try_element_at("others", t["t"]), F.array().cast("array<string>")).alias("o")
        ),
    )
    full = written(bare.join(others, "fid", "left").select("fid", named.alias("x")), "name-tokens")
    words = bare.select(F.explode("x").alias("x")).where("x.k != 'i'").select(F.col("x.t").alias("word"), (F.col("x.k") == "p").alias("abbreviated"))
    known = nick.select(F.col("t").alias("word"), F.lit(False).alias("abbreviated")).unionByName(nick.select("other", F.lit(False)).toDF("word", "abbreviated"))
    near = written(trie_join(words.unionByName(known).groupBy("word").agg(F.min("abbreviated").alias("abbreviated"))), "name-neighbours")
    # other names of a name, names of one other name, and what is near another name
    hop = lambda one, two: one.toDF("a", "m").join(two.toDF("m", "b"), "m").select("a", "b")
    alike = written(near.unionByName(hop(nick, near)).unionByName(hop(near, nick)).unionByName(hop(nick, nick)).distinct(), "name-alike")
    candidates = candidate_forms(full, alike)
    sides = candidates.join(full.select(F.col("fid").alias("f"), "x"), "f").join(full.select(F.col("fid").alias("g"), F.col("x").alias("y")), "g")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = lambda x: [(t["t"], t["k"], list(t["o"])) for t in x]
        for b in batches:
            strength = [agree(shape(x), shape(y)) for x, y in zip(b["x"], b["y"], strict=True)]
            exact = [any(t["k"] == "w" and t["t"] in {u["t"] for u in y} for t in x) for x, y in zip(b["x"], b["y"], strict=True)]
            got = pd.DataFrame({"f": b["f"], "g": b["g"], "strength": strength, "exact": exact})
            yield got[got["strength"] > 0]

    edges = written(sides.mapInPandas(judge, "f long, g long, strength int, exact boolean"), "name-edges")
    # a form whose companions are all initials says too little to link rows by itself
    full_words = F.size(F.filter("x", lambda t: t["k"] != "i"))
    weak = full.where((full_words <= 1) & (F.size("x") > full_words)).select("fid", F.lit(True).alias("weak"))
    of_row = spelled.select("id", F.xxhash64("form").alias("fid")).distinct().join(weak, "fid", "left")
    strong_rows = of_row.where(F.col("weak").isNull()).select("id", "fid")
    row_node = F.concat(F.lit("r"), F.col("id"))
    form_node = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    links = edges.where("strength = 2").select(form_node("f").alias("u"), form_node("g").alias("v")).unionByName(
        strong_rows.select(row_node.alias("u"), form_node("fid").alias("v"))
    )
    comp = written(components(links), "name-components")
    of_form = comp.where(F.col("node").startswith("f")).select(F.substring("node", 2, 32).cast("long").alias("fid"), "component")
    # rows with weak forms only: the one entity that fits, or other rows of the same forms if none does
    only_weak = of_row.groupBy("id").agg(F.count("weak").alias("w"), F.count(F.lit(1)).alias("n")).where("w = n").select("id")
    both = edges.select("f", "g", "exact").unionByName(edges.select(F.col("g").alias("f"), F.col("f").alias("g"), "exact"))
    home = both.join(of_form.withColumnRenamed("fid", "g"), "g")
    same = F.when(F.col("exact"), F.col("component"))  # an anchor met exactly goes before a similar one
    fits = home.groupBy("f").agg(
        F.coalesce(F.min(same), F.min("component")).alias("c"), F.coalesce(F.max(same), F.max("component")).alias("c2")
    )
    placed = of_row.join(only_weak, "id").join(fits, F.col("fid") == F.col("f"), "left")
    placed = placed.groupBy("id").agg(F.min("c").alias("c"), F.max("c2").alias("c2"), F.min("fid").alias("fid"))
    weak_home = (
        F.when(F.col("c").isNull(), F.concat(F.lit("w"), F.col("fid").cast("string")))
        .when(F.col("c") == F.col("c2"), F.col("c"))
        .otherwise(row_node)
    )
    homes = (
        comp.where(F.col("node").startswith("r"))
        .select(F.substring("node", 2, 1000).alias("id"), "component")
        .unionByName(placed.select("id", weak_home.alias("component")))
    )
    every = rows.select("id").distinct().join(homes, "id", "left").withColumn("component", F.coalesce("component", row_node))
    named = every.groupBy("component").agg(F.min("id").alias("entity"))
    return every.join(named, "component").select("id", "entity")


def linked_pairs(linked: DataFrame) -> DataFrame:
    a, b = linked.toDF("id_a", "entity"), linked.toDF("id_b", "entity")
    return a.join(b, "entity").where("id_a < id_b").select("id_a", "id_b")
