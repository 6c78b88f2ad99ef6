"""Fill containers of fixed capacity with documents (sizes in tokens).

Bin completion (branch and bound): the largest unplaced item opens a container,
the undominated ways of filling the rest are tried from the fullest down, and a
branch ends once its waste exceeds what a better solution could have. Best-fit
decreasing gives the first incumbent; when it meets the lower bound, it is
optimal and the search doesn't start. Items are dealt to shards of bounded
expected size by hash, so any number of documents, sources or equal sizes
spreads evenly; each shard is solved by itself.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoriq.llm.tokens import DEFAULT_RANKS, token_count


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Martello and Toth's bound L2: the volume bound, improved by items that can't share."""
    import numpy as np

    if not sizes:
        return 0
    s = np.sort(np.asarray(sizes, np.int64))
    sums = np.r_[0, np.cumsum(s)]
    half = np.searchsorted(s, capacity // 2, side="right")  # items from here on exceed half a container
    k = np.unique(np.r_[0, s[:half]])
    big = np.searchsorted(s, capacity - k, side="right")  # items from here on exceed capacity - k
    big = np.maximum(big, half)
    mid = big - half
    small = sums[half] - sums[np.searchsorted(s, k)]
    room = mid * capacity - (sums[big] - sums[half])
    return int(max(-(-sums[-1] // capacity), (len(s) - big + mid + np.maximum(0, -(-(small - room) // capacity))).max()))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free space, bin), sorted
    for s in sorted(sizes, reverse=True):
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([s])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(s)
            insort(room, (free - s, b))
    return bins


def fillings(left: Counter, values: list[int], room: int, least: int) -> Iterator[tuple[int, ...]]:
    """All undominated sets of the remaining sizes whose sum is within [least, room], the fullest first, lazily.

    Of equal sums those of large members come first. A set is dominated if an
    unused size could replace a smaller member, or two members together, and still
    fit.
    """
    reach, mask = 1, (1 << (room + 1)) - 1  # subset sums as bits
    steps = [reach]
    for v in values:
        for _ in range(min(left[v], room // v)):
            reach |= (reach << v) & mask
        steps.append(reach)
    reach &= ~((1 << max(least, 0)) - 1)

    def sets(k: int, rest: int) -> Iterator[tuple[int, ...]]:
        """Sets of the first k values with this sum."""
        if not rest:
            yield ()
            return
        v = values[k - 1]
        for n in range(min(left[v], rest // v) + 1):
            if steps[k - 1] >> (rest - n * v) & 1:
                for more in sets(k - 1, rest - n * v):
                    yield (*more, *(v,) * n)

    while reach:
        target = reach.bit_length() - 1
        reach ^= 1 << target
        slack = room - target
        for chosen in sets(len(values), target):
            if slack:
                used = Counter(chosen)
                low = set(chosen) | {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]}
                if any(y < x <= y + slack for x in values if left[x] > used[x] for y in low):
                    continue
            yield chosen


def _search(sizes: list[int], capacity: int, incumbent: list[list[int]], bound: int, budget: float) -> list[list[int]]:
    """Depth-first bin completion from the largest item on; ends at `bound`, after `budget` containers or when no branch is left."""
    total = sum(sizes)
    left, placed, waste = Counter(sizes), [], 0
    stack: list = []  # of (lazy alternatives, items left, number placed, waste) at each open container
    while budget > 0:
        budget -= 1
        allowed = (len(incumbent) - 1) * capacity - total - waste
        values = sorted((v for v, n in left.items() if n), reverse=True)
        if not values:
            if len(placed) < len(incumbent):
                incumbent = list(placed)
            if len(incumbent) <= bound:
                break
        elif allowed >= 0:
            first = values[0]
            rest = left.copy()
            rest[first] -= 1
            room = capacity - first
            options = fillings(rest, [v for v in values if rest[v] and v <= room], room, room - allowed)
            stack.append((options, first, rest, len(placed), waste))
        while stack:  # the next filling of the deepest container that has one
            options, first, rest, depth, before = stack[-1]
            f = next(options, None)
            if f is not None:
                left = rest.copy()
                left.subtract(f)
                placed = [*placed[:depth], [first, *f]]
                waste = before + capacity - first - sum(f)
                break
            stack.pop()
        else:
            break
    return incumbent


def complete(sizes: list[int], capacity: int, core: int = 64, budget: int | None = 400) -> list[list[int]]:
    """Pack positive sizes of at most `capacity`.

    Best fit decreasing is the incumbent. While it misses the lower bound, groups of
    `core` containers are opened, the emptiest first, and bin completion packs the
    items of each anew, until all were opened without gain. `budget` bounds the
    containers tried in a group: what it leaves out can cost containers, never
    items. With `budget=None` all containers are one group and the search goes on
    to the end, so that the result is optimal, in time that may grow exponentially.
    """
    bins, at = best_fit(sizes, capacity), 0
    bound = lower_bound(sizes, capacity)
    core, tries = (max(1, len(bins)), math.inf) if budget is None else (core, budget)
    bins.sort(key=sum)
    while len(bins) > bound and at < len(bins):
        opened = bins[at : at + core]
        items = [s for b in opened for s in b]
        least = max(lower_bound(items, capacity), len(opened) - (len(bins) - bound))
        better = _search(items, capacity, opened, least, tries) if least < len(opened) else opened
        if len(better) < len(opened):
            bins = sorted(bins[:at] + better + bins[at + core :], key=sum)
            at = 0
        else:
            at += core
    return bins


ASSIGNED = "doc_id long, piece_no int, token_start long, n_tokens long, container_id string"


def assign_containers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, shard_items: int = 4096, path: str = DEFAULT_RANKS) -> DataFrame:
    """Documents to containers: doc_id, piece_no, token_start, n_tokens, container_id.

    A document is cut only if it alone exceeds a container: into full containers
    and a remainder that is packed like any item. A document without tokens (null
    or empty text) has one row with a null container. Every input row is an item
    of its own; repeated rows and null ids stay apart. `shard_items` is the
    expected number of items packed together.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), token_count(path)(F.col(text_col)).alias("size")).withColumn(
        "row_no", F.monotonically_increasing_id()
    )
    # one shard more for every `shard_items` rows; the count reads no text
    shards = max(1, -(-docs.select(F.lit(1)).count() // shard_items))
    full = F.floor(F.col("size") / capacity)
    pieces = sized.select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("int"))).alias("piece_no")
    ).select(
        "doc_id",
        "piece_no",
        (F.col("piece_no").cast("long") * capacity).alias("token_start"),
        F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece_no") * capacity).alias("n_tokens"),
        (F.col("piece_no") < full).alias("fills"),
        F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(shards)).cast("int").alias("shard"),
        "row_no",
    )

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Streams a partition ordered by shard; holds one shard at a time."""
        held: list[pd.DataFrame] = []

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            shard = int(frame["shard"].iloc[0])
            waiting: dict[int, list[int]] = {}
            for at, (n, fills) in enumerate(zip(frame["n_tokens"], frame["fills"], strict=True)):
                if not fills and n:
                    waiting.setdefault(n, []).append(at)
            names: list[str | None] = [f"{shard}-f{k}" if fills else None for k, fills in enumerate(frame["fills"])]
            for k, b in enumerate(complete([n for n, at in waiting.items() for _ in at], capacity)):
                for n in b:
                    names[waiting[n].pop()] = f"{shard}-{k}"
            return frame.assign(container_id=names)[["doc_id", "piece_no", "token_start", "n_tokens", "container_id"]]

        for batch in part:
            for _, rows in batch.groupby("shard", sort=False):
                if held and held[0]["shard"].iloc[0] != rows["shard"].iloc[0]:
                    yield solve(pd.concat(held, ignore_index=True))
                    held = []
                held.append(rows)
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    # small in bytes, heavy in time: a number of partitions of its own, so that they aren't merged
    cores = docs.sparkSession.sparkContext.defaultParallelism
    by_shard = pieces.repartition(min(shards, max(4 * cores, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "shard").sortWithinPartitions("shard", "doc_id", "row_no", "piece_no")
    schema = ASSIGNED.replace("doc_id long", f"doc_id {docs.schema[id_col].dataType.simpleString()}")
    return by_shard.mapInPandas(run, schema)


def packing_report(assigned: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers, tokens, the volume bound and the share of space used."""
    per = assigned.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("used").alias("n_tokens"),
        F.sum("items").alias("n_items"),
        F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / capacity).alias("volume_bound"),
        (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )
