"""Connected components of an edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoriq.session import written


def components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 64) -> DataFrame:
    """(node, component): each node of the edges with the smallest node it is connected to.

    Large-star and small-star in turn until nothing changes; every round is
    written to the shared folder. No node's neighbours are gathered: both steps
    are a minimum per node joined back, so a hub is one row of an aggregate.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").distinct(), "cc")
    before = None
    for _ in range(most_rounds):
        # large-star: neighbours above u go to the least of u's neighbourhood
        ways = both(now)
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its neighbours below it go to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        now = written(small.distinct(), "cc")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
