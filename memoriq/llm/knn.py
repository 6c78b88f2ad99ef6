"""Most similar vectors by shifted space-filling curves.

Each of several curves projects the unit vectors on a few random orthonormal
directions, shifts the grid and orders all vectors by their Hilbert key. Spark
range-partitions and sorts every ordering; a window slides over it and every
vector keeps the best of those that stand within `window` places of it, by
16-bit copies and matrix products. The last rows of a partition meet the first
of the next in a second pass over those edges only, so that no neighbourhood is
cut by a partition bound. Keys are fine enough (two words) to order the members
of dense groups too, by another curve each time. Curves are run a few at a time, and the lists of a
vector merged; what remains is reranked on the full vectors.

Equal vectors are one point of the curves, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memoriq.session import remove_path, written

CURVES, DIRECTIONS, BITS, WINDOW = 20, 8, 14, 1024
#: Curves run at once: bounds what is shuffled at a time.
ROUND = 5
#: 16-bit copies choose so many places more than asked for; the full vectors then decide.
SPARE = 3
#: Rounding to 16 bits moves a cosine by less than this.
ROUNDING = 5e-4


def hilbert_keys(grid, bits: int, split: int = 0):
    """Hilbert indices of integer points (n, m) with coordinates below 2**bits, by Skilling's transform.

    With `split`, two arrays: the index by all but the lowest `split` bits of each coordinate, and what these add.
    """
    import numpy as np

    x = grid.astype(np.int64).copy()
    n, m = x.shape
    top = q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(m):
            high = (x[:, i] & q) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, m):
        x[:, i] ^= x[:, i - 1]
    turn, q = np.zeros(n, np.int64), top
    while q > 1:
        turn ^= np.where((x[:, m - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    keys = []
    for high, low in ((bits, split), (split, 0)):
        key = np.zeros(n, np.int64)
        for bit in range(high - 1, low - 1, -1):
            for i in range(m):
                key = key << 1 | (x[:, i] >> bit) & 1
        keys.append(key)
    return tuple(keys) if split else keys[0]


def curve_points(vectors, curve: int, directions: int, bits: int):
    """Grid coordinates of unit vectors on one curve: random rotation, scale, shift."""
    import numpy as np

    rng = np.random.default_rng(7_000 + curve)
    d = vectors.shape[1]
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0][:, : min(directions, d)]
    z = vectors @ basis * np.sqrt(d)  # about standard normal
    shift = rng.random(basis.shape[1]) * (1 << max(0, bits - 5))  # within a coarse cell
    return np.clip((z / 6 + 0.5) * (1 << bits) + shift, 0, (1 << bits) - 1).astype(np.int64)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Latest row per (profile, id), then without null, wrong-sized and zero vectors.

    Columns expected: profile, id, embedding, updated_at. Of rows equally late the
    largest vector (by its elements in order) counts; a null time is earliest.
    """
    one = (
        vectors.where(F.col("id").isNotNull() & F.col("profile").isNotNull())
        .groupBy("profile", "id")
        .agg(F.max(F.struct("updated_at", "embedding")).alias("v"))
        .select("profile", "id", F.col("v.embedding").alias("embedding"))
    )
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return one.where((F.size("embedding") == dim) & sound).withColumn("node", F.xxhash64("profile", "embedding"))


_LIST = "node long, others binary, cosines binary"
_EDGE = _LIST + ", kind string, part int, profile string, curve int, key long, fine long, code binary, scale float"


def _lists(runs, nodes, codes, scales, window: int, places: int, least: float | None, block: int = 512):
    """(node, other, cosine) arrays: the `places` most similar of each row among those within the window and its run."""
    import numpy as np

    n, found = len(nodes), []
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if n else np.zeros(0, np.int64)
    unit = codes * scales[:, None]
    for first, end in zip(starts, np.r_[starts[1:], n], strict=True):
        for a in range(first, end, block):
            b = min(a + block, end)
            lo, hi = max(first, a - window), min(end, b + window)
            cos = unit[a:b] @ unit[lo:hi].T
            row, col = np.arange(a, b)[:, None], np.arange(lo, hi)[None, :]
            cos[(np.abs(row - col) > window) | (nodes[a:b, None] == nodes[None, lo:hi])] = -2
            width = hi - lo
            if width > 64 * places:
                # the best stand in the best of the columns' classes
                classes = width // 16
                top = cos[:, : classes * 16].reshape(b - a, 16, classes).max(1)
                best = np.argpartition(-top, places - 1, axis=1)[:, :places]
                at = (best[:, :, None] + classes * np.arange(16)).reshape(b - a, -1)
                rest = np.broadcast_to(np.arange(classes * 16, width), (b - a, width - classes * 16))
                at = np.concatenate([at, rest], axis=1)
                near = np.take_along_axis(cos, at, 1)
            else:
                at, near = np.broadcast_to(np.arange(width), cos.shape), cos
            if near.shape[1] > places:
                keep = np.argpartition(-near, places - 1, axis=1)[:, :places]
                at, near = np.take_along_axis(at, keep, 1), np.take_along_axis(near, keep, 1)
            ok = near >= (-1.5 if least is None else least)
            found.append((np.broadcast_to(nodes[a:b, None], ok.shape)[ok], nodes[lo + at[ok]], near[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best(node, other, cosine, places: int) -> pd.DataFrame:
    """One row per node with its `places` best others, each once."""
    import numpy as np

    order = np.lexsort((-cosine, other, node))
    node, other, cosine = node[order], other[order], cosine[order]
    new = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])] if len(node) else np.zeros(0, bool)
    node, other, cosine = node[new], other[new], cosine[new]
    order = np.lexsort((other, -cosine, node))
    node, other, cosine = node[order], other[order], cosine[order]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    ends = np.minimum(np.r_[starts[1:], len(node)], starts + places)
    other, cosine = other.astype(np.int64), cosine.astype(np.float32)
    pairs = list(zip(starts, ends, strict=True))
    return pd.DataFrame({"node": node[starts], "others": [other[a:b].tobytes() for a, b in pairs], "cosines": [cosine[a:b].tobytes() for a, b in pairs]})


def _opened(b: pd.DataFrame):
    """(node, other, cosine) arrays of rows with lists."""
    import numpy as np

    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    others = np.frombuffer(b"".join(b["others"]), np.int64)
    return np.repeat(b["node"].to_numpy(np.int64), [len(x) // 8 for x in b["others"]]), others, np.frombuffer(b"".join(b["cosines"]), np.float32)


def merged_lists(lists: DataFrame, places: int) -> DataFrame:
    """One list per node out of several."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if not len(b):
                continue
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            last = rows["node"].to_numpy() == rows["node"].iloc[-1]
            yield _best(*_opened(rows[~last]), places)
            held = _best(*_opened(rows[last]), places)
        if held is not None:
            yield held

    return lists.repartition("node").sortWithinPartitions("node").mapInPandas(merge, _LIST)


def near_lists(
    reps: DataFrame, places: int, least: float | None = None, curves: int = CURVES, directions: int = DIRECTIONS, bits: int = BITS, window: int = WINDOW
) -> DataFrame:
    """(u, v, cosine): of each point the `places` most similar others that the curves find. `reps` has node, profile, embedding."""
    bound = None if least is None else least - ROUNDING

    def placing(some: range):
        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import numpy as np

            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["embedding"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(1)[:, None]
                x /= np.linalg.norm(x, axis=1)[:, None]
                step = np.abs(x).max(1) / 32767
                code = np.rint(x / step[:, None]).astype(np.int16)
                codes = [c.tobytes() for c in code]
                scale = (1 / np.linalg.norm(code.astype(np.float64), axis=1)).astype(np.float32)
                for c in some:
                    key, fine = hilbert_keys(curve_points(x, c, directions, bits), bits, bits // 2)
                    yield pd.DataFrame({"profile": b["profile"], "curve": c, "key": key, "fine": fine, "node": b["node"], "code": codes, "scale": scale})

        return place

    def arrays(b: pd.DataFrame):
        import numpy as np

        codes = np.frombuffer(b"".join(b["code"]), np.int16).reshape(len(b), -1).astype(np.float32)
        run = b["curve"].to_numpy(np.int64) << 32 | pd.factorize(b["profile"])[0]
        return run, b["node"].to_numpy(np.int64), codes, b["scale"].to_numpy(np.float32)

    names = [c.split()[0] for c in _EDGE.split(", ")]
    blank = {"kind": "list", "part": -1, "profile": None, "curve": -1, "key": 0, "fine": 0, "code": None, "scale": 0.0}

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, tail, head = TaskContext.get().partitionId(), None, None

        def edge(rows: pd.DataFrame, kind: str) -> pd.DataFrame:
            return rows.assign(kind=kind, part=part + (kind == "tail"), others=None, cosines=None)[names]

        for b in batches:
            if not len(b):
                continue
            if head is None or len(head) < window:
                head = b[:window] if head is None else pd.concat([head, b])[:window]
            rows = b if tail is None else pd.concat([tail, b], ignore_index=True)
            yield _best(*_lists(*arrays(rows), window, places, bound), places).assign(**blank)[names]
            tail = rows[-window:]
        if head is not None:
            yield edge(head, "head")
            yield edge(tail, "tail")

    order = ["profile", "curve", "key", "fine", "node"]

    def join_edges(rows: pd.DataFrame) -> pd.DataFrame:
        # tail of the earlier partition first
        rows = rows.sort_values(["kind", *order], ascending=[False] + [True] * len(order))
        if rows["kind"].nunique() < 2:
            return pd.DataFrame({"node": [], "others": [], "cosines": []}).astype({"node": "int64"})
        return _best(*_lists(*arrays(rows), window, places, bound), places)

    found = None
    for first in range(0, curves, ROUND):
        some = range(first, min(first + ROUND, curves))
        placed = reps.select("node", "profile", "embedding").mapInPandas(
            placing(some), "profile string, curve int, key long, fine long, node long, code binary, scale float"
        )
        ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        slid = written(ordered.mapInPandas(slide, _EDGE), "curve-windows")
        over = slid.where("kind <> 'list'").groupBy("part").applyInPandas(join_edges, _LIST)
        lists = slid.where("kind = 'list'").select("node", "others", "cosines").unionByName(over)
        lists = written(merged_lists(lists, places), "curve-lists")
        remove_path(reps.sparkSession, slid.inputFiles()[0].rpartition("/")[0])
        found = lists if found is None else found.unionByName(lists)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            node, other, _ = _opened(b)
            yield pd.DataFrame({"u": node, "v": other})

    pairs = merged_lists(found, places).mapInPandas(split, "u long, v long")
    unit = reps.select("node", "embedding")
    both = pairs.join(unit.toDF("u", "a"), "u").join(unit.toDF("v", "b"), "v")

    def cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            if not len(b):
                continue
            x, y = (np.stack(b[c].to_numpy()).astype(np.float64) for c in "ab")
            x, y = (v / np.abs(v).max(1)[:, None] for v in (x, y))
            dot = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pd.DataFrame({"u": b["u"], "v": b["v"], "cosine": dot})

    exact = both.mapInPandas(cosines, "u long, v long, cosine double")
    return exact if least is None else exact.where(F.col("cosine") >= least)


def similar_vectors(vectors: DataFrame, k: int = 5, least: float | None = None, dim: int = 64, **curve_options) -> DataFrame:
    """The k most similar of each vector; with `least`, only those of them with at least that cosine.

    Returns profile, id, neighbour, cosine, rank. Ties go to the smaller id, and
    equal vectors rank first. Of any number of equal vectors each gets its k
    (the first by id); no list of all pairs among copies is formed. Vectors of
    different profiles are never compared. An empty input gives no rows; further
    columns are not read.
    """
    points = written(usable(vectors.select("profile", "id", "embedding", "updated_at"), dim), "vectors")
    reps = points.groupBy("node").agg(
        F.any_value("profile").alias("profile"), F.any_value("embedding").alias("embedding"), F.count(F.lit(1)).alias("n")
    )
    reps = written(reps, "vector-points")
    members = points.select("node", "profile", "id")
    place = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    first = members.withColumn("place", place).where(F.col("place") <= k + 1)  # limited before the shuffle
    lists = written(near_lists(reps, k + SPARE, least, **curve_options), "vector-lists")
    sizes = reps.select("node", "n")
    # copies of one vector
    twins = (
        members.join(sizes.where("n > 1").select("node"), "node")
        .join(first.select("node", F.col("id").alias("neighbour")), "node")
        .where(F.col("id") != F.col("neighbour"))
        .select("profile", "id", "neighbour", F.lit(1.0).alias("cosine"))
    )
    # other vectors: a point with more than k copies has no place left for them
    ways = lists.select(F.col("u").alias("node"), F.col("v").alias("other"), "cosine")
    ways = ways.join(sizes.where(F.col("n") <= k).select("node"), "node")
    nearest = ways.join(first.where(F.col("place") <= k).select(F.col("node").alias("other"), F.col("id").alias("neighbour")), "other")
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "neighbour"))
    nearest = nearest.withColumn("r", best).where(F.col("r") <= k).select("node", "neighbour", "cosine")
    others = members.join(nearest, "node").select("profile", "id", "neighbour", "cosine")
    rank = F.row_number().over(Window.partitionBy("profile", "id").orderBy(F.desc("twin"), F.desc("cosine"), "neighbour"))
    both = twins.withColumn("twin", F.lit(1)).unionByName(others.withColumn("twin", F.lit(0)))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).drop("twin")


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs (id_a < id_b) of which at least one is a neighbour of the other."""
    return neighbours.select(
        F.col("profile").alias("profile_safe_id"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")
    ).distinct()
