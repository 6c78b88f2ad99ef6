"""Mix sources to target shares of all tokens, with a cap on repeats.

Every target source gets a token budget: the largest total at which no source
needs a document more often than allowed, times its share. A budget takes the
whole source as often as it fits; for the remainder documents are counted by
exact token length, each length gives its proportional number, and a bounded
knapsack over the lengths (sums as bits) comes as near to the budget as any choice.
Within a length the documents are chosen by seeded hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memoriq.llm.tokens import DEFAULT_RANKS, token_count


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take: the sum is at most `budget` and as near to it as any choice comes.

    Proportional numbers come first and are filled up from the longest on. What is
    then missing is less than the longest length L (all divided by their common
    divisor), and some best choice differs in at most 2 L items: put its additions
    and removals in an order that keeps the running sum within L of zero; if a sum
    came twice, what lies between could be left out. So a bounded knapsack over
    additions and removals (each length in powers of two) within 2 L * L of the
    start is exact. It ends at once where the budget is met, and first tries two
    items a length.
    """
    import math

    import numpy as np

    at = [i for i, (n, c) in enumerate(zip(lengths, counts, strict=True)) if n > 0 and c > 0]
    total = sum(lengths[i] * counts[i] for i in at)
    if budget >= total:
        return list(counts)
    take = [0] * len(counts)
    if budget <= 0:
        return take
    unit = math.gcd(*(lengths[i] for i in at))
    size = {i: lengths[i] // unit for i in at}
    rest, total = budget // unit, total // unit
    share = rest
    for i in at:
        take[i] = counts[i] * share // total
        rest -= size[i] * take[i]
    at.sort(key=lambda i: -size[i])
    for i in at:
        more = min(counts[i] - take[i], rest // size[i])
        take[i] += more
        rest -= more * size[i]
    longest = size[at[0]]
    for most in (2, 2 * longest):
        if not rest:
            break
        span = min(2 * longest * longest, most * sum(size.values()))
        mask, reach, pieces = (1 << (2 * span + 1)) - 1, 1 << span, []
        by = np.full(2 * span + 1, -1, np.int32)  # the piece that first reached a sum
        goal = 1 << (span + rest)
        for i in reversed(at):
            for sign, free in ((1, counts[i] - take[i]), (-1, take[i])):
                free, k = min(free, most), 1
                while free > 0 and not reach & goal:
                    k = min(k, free)
                    move = k * size[i]
                    new = ((reach << move if sign > 0 else reach >> move) & mask) & ~reach
                    if new:
                        bits = np.frombuffer(new.to_bytes((2 * span + 8) // 8, "little"), np.uint8)
                        by[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(pieces)
                        reach |= new
                    pieces.append((i, sign * k))
                    free -= k
                    k *= 2
        if reach & goal or most > 2:
            s = (reach & ((goal << 1) - 1)).bit_length() - 1
            rest -= s - span
            while by[s] >= 0:
                i, k = pieces[by[s]]
                take[i] += k
                s -= k * size[i]
            break
    return take


#: Sources a mixture may have: their targets and sums are held by the driver.
MOST_SOURCES = 10_000


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_RANKS) -> DataFrame:
    """The documents taken: doc_id, source, n_tokens, copies (at most max_repeats).

    Source names are compared trimmed and in lower case; documents of other or
    null sources take no part. Without `total_tokens` the total is the largest
    that all target shares allow; a larger wish is cut to it. A target source
    without any token is left out of that bound (its share can't be reached).
    Documents without tokens are never taken. Repeated rows count as documents of
    their own. More than MOST_SOURCES target sources are an error.
    """
    spark = docs.sparkSession
    goal = targets.select(
        F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("cap")
    ).where((F.col("share") > 0) & (F.col("cap") > 0))
    wanted = {r["source"]: (r["share"], r["cap"]) for r in goal.limit(MOST_SOURCES + 1).collect()}
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    sized = (
        docs.select(F.col(id_col).alias("doc_id"), F.lower(F.trim("source")).alias("source"), F.col(text_col).alias("text"))
        .join(F.broadcast(goal.select("source")), "source", "left_semi")
        .select("doc_id", "source", token_count(path)("text").alias("n_tokens"), F.monotonically_increasing_id().alias("row_no"))
        .where(F.col("n_tokens") > 0)
        .select("doc_id", "source", "n_tokens", F.xxhash64(F.lit(seed), "doc_id", "row_no").alias("draw"))
    )
    from memoriq.session import written

    sized = written(sized, "mix-sizes")  # tokens are counted once
    histogram = sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("c"))
    sums = {r["source"]: r["t"] for r in histogram.groupBy("source").agg(F.sum(F.col("c") * F.col("n_tokens")).alias("t")).collect()}
    most = min((sums[s] * cap / share for s, (share, cap) in wanted.items() if sums.get(s)), default=0.0)
    total = most if total_tokens is None else min(float(total_tokens), most)
    budgets = {s: int(total * share) for s, (share, _) in wanted.items()}

    def plan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        source = key[0]
        rows = rows.sort_values("n_tokens")
        lengths, counts = rows["n_tokens"].tolist(), rows["c"].tolist()
        whole, rest = divmod(budgets[source], sums[source])
        whole = min(whole, wanted[source][1])
        extra = fit_budget(lengths, counts, rest) if whole < wanted[source][1] else [0] * len(counts)
        return pd.DataFrame({"source": source, "n_tokens": lengths, "whole": whole, "extra": extra})

    chosen = histogram.groupBy("source").applyInPandas(plan, "source string, n_tokens long, whole long, extra long")
    # rank within (source, length) in two steps, so that no window holds a whole length
    bucket = F.pmod(F.shiftright("draw", 8), F.lit(256)).cast("int")
    keyed = sized.withColumn("b", bucket)
    offsets = keyed.groupBy("source", "n_tokens", "b").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("source", "n_tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        offsets.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
        .join(chosen, ["source", "n_tokens"])
        .where((F.col("whole") > 0) | (F.col("before") < F.col("extra")))
        .drop("k")
    )
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "b").orderBy("draw", "doc_id"))
    picked = keyed.join(offsets, ["source", "n_tokens", "b"]).withColumn("nth", rank + F.col("before"))
    copies = F.col("whole") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)
    return picked.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where(F.col("copies") > 0)


def shares_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: documents, tokens and share reached against the target."""
    got = mix.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    goal = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    full = goal.join(got, "source", "left").fillna(0, ["n_docs", "tokens", "most_copies"])
    return full.withColumn("actual_share", F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1)))
