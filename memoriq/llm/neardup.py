"""Near-duplicate texts: Jaccard similarity of word shingles, by BK-trees, without loss.

Texts with the same shingle set are one node. A node's shingles are ordered from
rare to common, by their exact numbers over the whole collection. Two sets of
similarity t or more share one of the first n - ceil(t n) + 1, so every such
shingle that stands in a second set names a shard, and each shard holds BK-trees
of its nodes.

The trees' metric is the Hamming distance of parity sketches (256 to 4,096 bits,
by the size of the set): bit j is the parity of the number of shingles hashed to
j. One shingle in only one of two sets flips one bit, so the distance is at most
the size of their symmetric difference, which for a similarity of t is at most
(1 - t) / (1 + t) of the sum of the set sizes. That is the search radius: a
child hangs on its distance to its parent, and edges outside
[d - radius, d + radius] cannot lead to a partner. The trees of many shards are
built and walked together, level by level, in arrays. Survivors are verified on
the shingle sets themselves.

Numbers of shingles: sets are written in chunks; each chunk asks for its distinct
shingles by hash range, every range adds up who asks for what, and the answers (a
byte for each) go back to the chunk. A shingle of more than `shard_rows` sets is
spread over a triangular grid of shards, each of bounded size, which together
compare every two of its members.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoriq.llm.components import components
from memoriq.session import dropped, written

#: Longest runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
SHARD_ROWS = 2048
#: Shingles in a chunk, and asked for in a hash range, about.
CHUNK, RANGE = 1 << 17, 1 << 22

def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHashes(dict):
    """64-bit hashes of words, computed once."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(words: list[str], width: int, held: WordHashes):
    """Distinct 32-bit hashes of the runs of `width` words, as a sorted array; fewer words are one run. `held` caches words' hashes."""
    import numpy as np

    if len(held) > 1_000_000:
        held.clear()
    h = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    if not width:
        return np.zeros(0, np.uint32)
    s = h[:n].copy()
    for k in range(1, width):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((s >> np.uint64(32)).astype(np.uint32))


class Trees:
    """The BK-trees of several groups of keys under Hamming distance, one tree a group.

    `keys` is (n, words) of 64 bits, rows of a group adjacent. A group's first row
    is its root; a child hangs on its distance to the parent. Equal keys share a
    place, so that no chain grows.
    """

    def __init__(self, group, keys):
        import numpy as np

        n = len(group)
        self.keys, self.span = keys, keys.shape[1] * 64 + 1
        first = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        place = np.arange(n)
        row = np.flatnonzero(~first)
        at = self.root[row]
        parents, edges, children = [], [], []
        while len(row):
            d = self.distance(row, at)
            same = d == 0
            place[row[same]] = at[same]
            row, at, d = row[~same], at[~same], d[~same]
            order = np.argsort(at * self.span + d, kind="stable")
            row, at, d = row[order], at[order], d[order]
            new = np.r_[True, (at[1:] != at[:-1]) | (d[1:] != d[:-1])] if len(row) else np.zeros(0, bool)
            parents.append(at[new])
            edges.append(d[new])
            children.append(row[new])
            at = row[new][np.cumsum(new) - 1]
            row, at = row[~new], at[~new]
        parents, edges, children = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (parents, edges, children))
        order = np.argsort(parents * self.span + edges, kind="stable")
        self.ways, self.child = (parents * self.span + edges)[order], children[order]
        self.held = np.argsort(place, kind="stable")  # rows by the place that holds them
        self.held_from = np.searchsorted(place[self.held], np.arange(n + 1))

    def distance(self, a, b):
        import numpy as np

        return np.bitwise_count(self.keys[a] ^ self.keys[b]).sum(1, dtype=np.int64)

    def pairs(self, radius):
        """Arrays (earlier row, later row, distance): of each row the earlier rows of its group within its radius."""
        import numpy as np

        found = []
        row = np.arange(len(self.root))
        at = self.root
        while True:
            ahead = at < row  # a subtree holds later rows than its root
            row, at = row[ahead], at[ahead]
            if not len(row):
                break
            d = self.distance(row, at)
            hit = d <= radius[row]
            who, spot = _ranges(self.held_from[at[hit]], self.held_from[at[hit] + 1])
            other = self.held[spot]
            later = row[hit][who]
            found.append((other[other < later], later[other < later], d[hit][who][other < later]))
            low = np.searchsorted(self.ways, at * self.span + np.maximum(d - radius[row], 0))
            high = np.searchsorted(self.ways, at * self.span + np.minimum(d + radius[row], self.span - 1), side="right")
            who, spot = _ranges(low, high)
            row, at = row[who], self.child[spot]
        return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *found, strict=True))


def _ranges(low, high):
    """(number of the range, element) of all elements of the ranges [low, high)."""
    import numpy as np

    n = high - low
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def shingle_chunks(texts: DataFrame, width: int, min_words: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks of texts: ids and their nodes; nodes new to the task with the sizes and the shingles of their sets, one after the other.

    A node is the 64-bit hash of its set, the set its distinct 32-bit hashes in
    order. Null texts, texts without words and those below `min_words` words are
    left out; a text shorter than `width` words is one shingle. Two different
    shingles of one pair of texts share a hash with a chance of about n * m / 2**32.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash
        from pyspark import TaskContext

        held, done = WordHashes(), set()
        number = TaskContext.get().partitionId() << 32
        ids, nodes, own, sets = [], [], [], []

        def row() -> pd.DataFrame:
            out = {"chunk": number, "ids": [list(ids)], "nodes": [list(nodes)], "own": [list(own)], "sizes": [[len(x) for x in sets]]}
            out |= {"shingles": [np.concatenate([np.zeros(0, np.uint32), *sets]).tobytes()], "n": sum(map(len, sets))}
            for x in (ids, nodes, own, sets):
                x.clear()
            return pd.DataFrame(out)

        size = 0
        for b in batches:
            for i, text in zip(b["id"], b["text"], strict=True):
                words = words_of(text)
                if len(words) >= max(min_words, 1):
                    x = shingle_hashes(words, width, held)
                    node = xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63)
                    ids.append(i)
                    nodes.append(node)
                    if node not in done:
                        done.add(node)
                        own.append(node)
                        sets.append(x)
                        size += len(x)
                    if size >= chunk or len(ids) >= chunk:
                        yield row()
                        number, size = number + 1, 0
        if ids:
            yield row()

    rows = texts.select("id", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    kind = texts.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"chunk long, ids array<{kind}>, nodes array<long>, own array<long>, sizes array<int>, shingles binary, n long")


def coded(count):
    """A count as one byte, in order: itself up to 64, then eight steps for every doubling."""
    import numpy as np

    return np.minimum(255, np.where(count <= 64, count, 64 + np.ceil(8 * np.log2(np.maximum(count, 1) / 64)))).astype(np.uint8)


def decoded(code: int) -> float:
    """The largest count of a code."""
    return float(code) if code <= 64 else 64 * 2 ** ((code - 64) / 8)


def counted(chunks: DataFrame, range_size: int = RANGE) -> DataFrame:
    """The chunks with `codes`: for each of their shingles the number of sets that have it, as a byte; a written table.

    The chunks must be a written table and are deleted. Numbers are exact, but a set in several tasks counts once for each.
    """
    spark = chunks.sparkSession
    total = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(6, (-(-total // range_size) - 1).bit_length())
    parts = max(spark.sparkContext.defaultParallelism, min(1 << bits, -(-4 * total // range_size)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for chunk, packed in zip(b["chunk"], b["shingles"], strict=True):
                asked, times = np.unique(np.frombuffer(packed, np.uint32), return_counts=True)
                at = np.searchsorted(asked >> np.uint32(32 - bits), np.arange((1 << bits) + 1)).tolist()
                used = [k for k in range(1 << bits) if at[k] < at[k + 1]]
                times = times.astype(np.uint32)
                yield pd.DataFrame(
                    {
                        "part": pd.Series(used, dtype="int32"),
                        "chunk": chunk,
                        "asked": [asked[at[k] : at[k + 1]].tobytes() for k in used],
                        "times": [times[at[k] : at[k + 1]].tobytes() for k in used],
                    }
                )

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            asked = np.frombuffer(b"".join(rows["asked"]), np.uint32)
            _, which = np.unique(asked, return_inverse=True)
            code = coded(np.bincount(which, np.frombuffer(b"".join(rows["times"]), np.uint32)))[which].tobytes()
            ends = np.cumsum([len(x) // 4 for x in rows["asked"]]).tolist()
            return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "codes": [code[a:e] for a, e in zip([0, *ends], ends, strict=False)]})

        for chunk in whole_groups(batches, "part", 0):
            for _, rows in chunk.groupby("part", sort=False):
                yield solve(rows)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            codes = []
            for packed, answers in zip(b["shingles"], b["answers"], strict=True):
                _, which = np.unique(np.frombuffer(packed, np.uint32), return_inverse=True)
                answers = answers if answers is not None else []
                codes.append(np.frombuffer(b"".join(a["codes"] for a in answers), np.uint8)[which].tobytes())
            yield b.drop(columns=["answers"]).assign(codes=codes)

    asked = chunks.select("chunk", "shingles").mapInPandas(ask, "part int, chunk long, asked binary, times binary")
    codes = asked.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(answer, "chunk long, part int, codes binary")
    codes = written(codes, "shingle-codes")  # ends the shuffle of what was asked
    answers = codes.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "codes"))).alias("answers"))  # as many bytes as the chunk has shingles
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema) + ", codes binary"
    sets = written(chunks.join(answers, "chunk", "left").mapInPandas(merge, schema), "shingles")
    dropped(chunks)
    dropped(codes)
    return sets


def mark_bits(n: int) -> int:
    """Width of the parity sketch of a set of n: enough that unrelated sets stay apart."""
    return min(4096, max(256, 1 << (2 * n - 1).bit_length()))


def whole_groups(batches: Iterator[pd.DataFrame], by: str, rows: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by `by`, in pieces of at least `rows` that cut no group."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        if sum(map(len, held)) >= rows and held[0][by].iloc[0] != b[by].iloc[-1]:
            piece = pd.concat(held, ignore_index=True)
            at = int(piece[by].searchsorted(piece[by].iloc[-1]))
            held = [piece[at:]]
            yield piece[:at]
    if held:
        yield pd.concat(held, ignore_index=True)


def near_rows(shard, nodes, sizes, marks, threshold: float):
    """Pairs (u, v) of nodes that meet in a shard within the radius, each once; rows of a shard are adjacent.

    Sketches fold: the halves' parities added are the sketch of half the width. A
    tree holds the nodes of its own width and wider ones folded down to it, and two
    nodes meet in the tree of the narrower.
    """
    import numpy as np

    spread = (1 - threshold) / (1 + threshold)
    width = np.fromiter(map(len, marks), np.int64, len(marks))  # in bytes
    least = np.fromiter((mark_bits(max(1, n)) // 8 for n in np.floor(threshold * sizes).astype(int).tolist()), np.int64, len(sizes))
    rows, keys = np.zeros(0, np.int64), None
    found = []
    w = int(width.max(initial=32))
    while w >= 32:
        own = np.flatnonzero(width == w)
        fresh = np.frombuffer(b"".join(marks[own]), np.uint64).reshape(len(own), w // 8)
        if keys is not None:
            stay = least[rows] <= w
            rows, keys = rows[stay], keys[stay]
            fresh = np.concatenate([fresh, keys[:, : w // 8] ^ keys[:, w // 8 :]])
            own = np.concatenate([own, rows])
            order = np.argsort(own, kind="stable")
            own, fresh = own[order], fresh[order]
        rows, keys = own, fresh
        if (width[rows] == w).any():
            n = sizes[rows]
            i, j, d = Trees(shard[rows], keys).pairs(np.floor(spread * (n + n / threshold) + 1e-9).astype(np.int64))
            a, b = n[i], n[j]
            ok = (d <= spread * (a + b) + 1e-9) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)
            i, j = rows[i[ok]], rows[j[ok]]
            ok = (nodes[i] != nodes[j]) & ((width[i] == w) | (width[j] == w))
            found.append(np.stack([np.minimum(nodes[i[ok]], nodes[j[ok]]), np.maximum(nodes[i[ok]], nodes[j[ok]])]))
        w //= 2
    u, v = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
    return u[new], v[new]


def placed_rows(nodes, sizes, shingles, codes, threshold: float, shard_rows: int):
    """(shard, set, marks): the shards of each set of a chunk, and every set's parity sketch."""
    import numpy as np

    n = len(sizes)
    which = np.repeat(np.arange(n), sizes)
    # rare first, equally common ones by hash
    order = np.argsort(which << 40 | codes.astype(np.int64) << 32 | shingles)
    starts = np.cumsum(sizes) - sizes
    prefix = sizes - np.ceil(np.round(threshold * sizes, 9)).astype(np.int64) + 1
    order = order[np.arange(len(order)) - starts[which] < prefix[which]]
    order = order[codes[order] > 1]  # a shingle of one set has no partner
    hot = codes[order] > coded(np.array(shard_rows))
    cold, hot = order[~hot], order[hot]
    shard, owner = [shingles[cold].astype(np.int64) << 31], [which[cold]]
    for c in np.unique(codes[hot]).tolist():
        some = hot[codes[hot] == c]
        g = -(-int(decoded(c)) // shard_rows)
        row = (nodes[which[some]] % g)[:, None]
        cell = np.arange(g)[None]
        low, high = np.minimum(row, cell), np.maximum(row, cell)
        shard.append((shingles[some].astype(np.int64)[:, None] << 31 | high * (high + 1) // 2 + low + 1).ravel())
        owner.append(np.repeat(which[some], g))
    width = np.fromiter(map(mark_bits, sizes.tolist()), np.int64, n)
    marks = np.empty(n, object)
    for w in np.unique(width).tolist():
        some = np.flatnonzero(width == w)
        mine = width[which] == w
        local = np.searchsorted(some, which[mine])
        bits = np.bincount(local * w + (shingles[mine] & np.uint32(w - 1)), minlength=len(some) * w) & 1
        packed = np.packbits(bits.astype(np.uint8)).tobytes()
        marks[some] = [packed[k : k + w // 8] for k in range(0, len(packed), w // 8)]
    shard, owner = np.concatenate(shard), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")  # rows of a set beside each other compress well
    return shard[order], owner[order], marks


def similar_sets(sets: DataFrame, threshold: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All pairs of nodes (u < v, similarity) of counted chunks at or above the threshold."""
    import numpy as np

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own, sizes, packed, codes in zip(b["own"], b["sizes"], b["shingles"], b["codes"], strict=True):
                nodes, sizes = np.asarray(own, np.int64), np.asarray(sizes, np.int64)
                shard, owner, marks = placed_rows(nodes, sizes, np.frombuffer(packed, np.uint32), np.frombuffer(codes, np.uint8), threshold, shard_rows)
                for at in range(0, len(shard), 200_000):
                    some = owner[at : at + 200_000]
                    yield pd.DataFrame({"shard": shard[at : at + 200_000], "node": nodes[some], "n": sizes[some].astype(np.int32), "mark": marks[some]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, "shard", 200_000):
            u, v = near_rows(b["shard"].to_numpy(np.int64), b["node"].to_numpy(np.int64), b["n"].to_numpy(np.int64), b["mark"].to_numpy(), threshold)
            yield pd.DataFrame({"u": u, "v": v})

    placed = sets.select("own", "sizes", "shingles", "codes").mapInPandas(shards, "shard long, node long, n int, mark binary")
    near = placed.repartition("shard").sortWithinPartitions("shard").mapInPandas(search, "u long, v long").distinct()
    return verified(written(near, "near-candidates"), sets, threshold)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold."""
    import numpy as np

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own, sizes, packed in zip(b["own"], b["sizes"], b["shingles"], strict=True):
                ends = (np.cumsum(sizes) * 4).astype(int).tolist()
                yield pd.DataFrame({"node": np.asarray(own, np.int64), "shingles": [packed[a:e] for a, e in zip([0, *ends], ends, strict=False)]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, v, x, y in zip(b["u"], b["v"], b["a"], b["b"], strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                k = len(np.intersect1d(x, y, assume_unique=True))
                if k >= threshold * (len(x) + len(y) - k) - 1e-12:
                    out.append((u, v, k / (len(x) + len(y) - k)))
            yield pd.DataFrame(out, columns=["u", "v", "similarity"])

    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    rows = sets.select("own", "sizes", "shingles").mapInPandas(unpack, "node long, shingles binary")
    one = rows.join(wanted, "node", "left_semi").dropDuplicates(["node"])  # one shuffle by node for both
    both = pairs.join(one.toDF("u", "a"), "u").join(one.toDF("v", "b"), "v")
    return both.select("u", "v", "a", "b").mapInPandas(compare, "u long, v long, similarity double")


def near_duplicates(texts: DataFrame, width: int = 5, threshold: float = 0.8, min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, node), and pairs of nodes with their similarity.

    Texts of one node have the same shingles. `texts` needs id and text; further
    columns are not read. A repeated (id, text) row counts once; null ids and
    texts are left out, as are texts without words or with fewer than `min_words`.
    """
    chunks = written(shingle_chunks(texts, width, min_words), "shingle-chunks")
    sets = counted(chunks)
    members = sets.select(F.explode(F.arrays_zip("ids", "nodes")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.nodes").alias("node"))
    return members.distinct(), similar_sets(sets, threshold)


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of ids (id_a < id_b), copies written out."""
    a, b = members.toDF("id_a", "node"), members.toDF("id_b", "node")
    copies = a.join(b, "node").where("id_a < id_b").select("id_a", "id_b")
    near = (
        pairs.join(members.toDF("x", "u"), "u")
        .join(members.toDF("y", "v"), "v")
        .where("x != y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return copies.unionByName(near).distinct()


def duplicate_groups(texts: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per id: group_id (the least id of its class), the group's size and the number of its links.

    Links join texts of different shingle sets; copies share a node and its links.
    Ids without any partner form a group of their own.
    """
    members, pairs = near_duplicates(texts, width, threshold)
    pairs = written(pairs, "near-pairs")
    ways = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    links = ways.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    found = members.join(components(pairs), "node", "left").join(links, "node", "left")
    ids = texts.select("id").where(F.col("id").isNotNull()).distinct()
    full = ids.join(found, "id", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("c")
    )
    named = full.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n_members"))
    return full.join(named, "c", "left").select(
        "id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_members", F.lit(1)).alias("n_members"), "n_links"
    )
