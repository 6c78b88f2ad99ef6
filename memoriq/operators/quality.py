"""Evaluation of rankings: MRR, nDCG, success, ablations, weight sweeps, labels, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memoriq.functions.scores import rank_key


def gain(grade: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + F.lit(1.0))


def metrics(ranked: DataFrame, grades: DataFrame, k: int = 5, by: tuple[str, ...] = (), runs: DataFrame | None = None) -> DataFrame:
    """Per query: rr, ndcg and success at k. `ranked` (by..., query_id, id, rank), `grades` (query_id, id, grade).

    `runs` lists the values of `by`; by default those of `ranked`.

    The ideal is taken from all grades of a query. Queries without grades don't
    count; graded queries without hits score 0.
    """
    g = grades.where(F.col("grade").isNotNull())
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))
    ideal = g.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("ideal"))
    top = ranked.where(F.col("rank") <= k)
    hits = top.join(g, ["query_id", "id"]).where("grade >= 1")
    per = hits.groupBy(*by, "query_id").agg(F.min("rank").alias("first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    if by:
        runs = (ranked if runs is None else runs).select(*by).distinct()
    frame = ideal if runs is None else ideal.crossJoin(F.broadcast(runs))  # one row for each run (ablation or weight set)
    rows = frame.join(per, [*by, "query_id"], "left")
    return rows.select(
        *by, "query_id",
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("ideal") > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("success"),
    )


def means(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return per_query.groupBy(*by).agg(
        F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("success"), 6).alias("success"), F.count(F.lit(1)).alias("n_queries")
    )


def weighted(hits: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Each run of `weights` (run, a, b, g, d) ranks the hits (query_id, id, semantic, recency, graph, lexical) anew; all runs in one plan."""
    score = F.col("a") * F.col("semantic") + F.col("b") * F.col("recency") + F.col("g") * F.col("graph") + F.col("d") * F.col("lexical")
    rows = hits.crossJoin(F.broadcast(weights)).withColumn("score", score)  # a stated set of weights
    order = Window.partitionBy("run", "query_id").orderBy(F.desc(rank_key(F.col("score"))), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def coarse_grid(spark: SparkSession, steps: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """(run, a, b, g, d) of the weights whose rest d isn't negative."""
    rows = [(a, b, g, 1.0 - a - b - g) for a in steps for b in steps for g in steps]
    rows = [r for r in rows if 0 <= r[3] <= 1]
    return spark.createDataFrame([(f"{a:g}/{b:g}/{g:g}", a, b, g, d) for a, b, g, d in rows], "run string, a double, b double, g double, d double")


def fine_grid(best: DataFrame) -> DataFrame:
    """Weights around those of `best` (a, b, g), clamped to [0, 1], rounded to three places, each once."""
    wide = F.array(*[F.lit(x) for x in (-0.1, -0.05, 0.0, 0.05, 0.1)])
    rows = best.select("a", "b", "g", F.explode(wide).alias("da")).select("*", F.explode(wide).alias("db")).select("*", F.explode(F.array(F.lit(-0.05), F.lit(0.0), F.lit(0.05))).alias("dg"))
    clamp = lambda c, d: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) + F.col(d)))
    rows = rows.select(clamp("a", "da").alias("a"), clamp("b", "db").alias("b"), clamp("g", "dg").alias("g")).withColumn("d", F.lit(1.0) - F.col("a") - F.col("b") - F.col("g"))
    rows = rows.where("d >= 0 AND d <= 1").select(*[F.round(c, 3).alias(c) for c in "abgd"]).distinct()
    return rows.select(F.concat_ws("/", *[F.col(c).cast("string") for c in "abg"]).alias("run"), "a", "b", "g", "d")


def best_weights(scored: DataFrame, n: int = 10) -> DataFrame:
    """By MRR, nDCG and then the larger weights."""
    return scored.orderBy(F.desc("mrr"), F.desc("ndcg"), F.desc("a"), F.desc("b"), F.desc("g"), F.desc("d")).limit(n)


def failure_labels(ranked: DataFrame, grades: DataFrame, queries: DataFrame, k: int = 5, lexical_limit: float = 0.3) -> DataFrame:
    """(query_id, label): no-truth, no-results, miss, lexical-hit, rank-issue, good or partial-top1. `ranked` has lexical."""
    g = grades.where(F.col("grade").isNotNull())
    top = ranked.where(F.col("rank") <= k).join(g, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    seen = top.groupBy("query_id").agg(
        F.max("grade").alias("best"), F.max(F.when(F.col("rank") == 1, F.col("grade"))).alias("top1"), F.max(F.when(F.col("rank") == 1, F.col("lexical"))).alias("lex1")
    )
    rows = queries.select("query_id").join(g.select("query_id").distinct().withColumn("graded", F.lit(True)), "query_id", "left").join(seen, "query_id", "left")
    label = (
        F.when(F.col("graded").isNull(), "no-truth")
        .when(F.col("best").isNull(), "no-results")
        .when(F.col("best") == 0, "miss")
        .when((F.col("top1") == 0) & (F.col("lex1") > lexical_limit), "lexical-hit")
        .when(F.col("top1") == 0, "rank-issue")
        .when(F.col("top1") == 2, "good")
        .when(F.col("top1") == 1, "partial-top1")
        .otherwise("unclassified")
    )
    return rows.select("query_id", label.alias("label"))


def label_table(labels: DataFrame, stratum: Column) -> DataFrame:
    return labels.withColumn("stratum", stratum).groupBy("stratum", "label").agg(F.count(F.lit(1)).alias("n"))


def parity(left: DataFrame, right: DataFrame, k: int = 5) -> DataFrame:
    """Per query: Jaccard of the two top-k sets, and Spearman's coefficient over what both have, by the places in either list (null if fewer than two)."""
    one = left.where(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("p"))
    two = right.where(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("q"))
    both = one.join(two, ["query_id", "id"], "full")
    n = F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull())
    square = F.coalesce(F.sum((F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))), F.lit(0))
    return both.groupBy("query_id").agg(
        (n / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("jaccard"),
        F.when(n >= 2, F.lit(1.0) - 6.0 * square / (n * (n * n - 1))).alias("spearman"),
        n.alias("common"),
    )


def overlap_grades(queries: DataFrame, memories: DataFrame, first: str = "names", second: str = "tags") -> DataFrame:
    """(query_id, id, grade): 2 where an element of `first` is shared, 1 where only one of `second` is. Joined on the elements, never all with all."""
    def shared(c: str, grade: int) -> DataFrame:
        q = queries.select("query_id", F.explode(F.array_distinct(c)).alias("x"))
        return q.join(memories.select("id", F.explode(F.array_distinct(c)).alias("x")), "x").select("query_id", "id", F.lit(grade).alias("grade"))

    return shared(first, 2).unionByName(shared(second, 1)).groupBy("query_id", "id").agg(F.max("grade").alias("grade"))


def overlap_counts(queries: DataFrame, memories: DataFrame, first: str = "names", second: str = "tags") -> DataFrame:
    """(query_id, grade, n): how many memories `overlap_grades` gives each grade, without its rows. Memories have one row per id.

    Queries that ask the same are counted once. A list of `second` alone decides
    how many share one of it; those that have grade 2 as well are taken off.
    """
    each = lambda rows, c: rows.select(c, F.array_distinct(c).alias("s")).select(c, F.explode("s").alias("x"))
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    asked = queries.groupBy("query_id").agg(whole(first), whole(second))
    m = memories.select("id", F.col(first).alias("f"), F.col(second).alias("s"))
    held = m.select("id", "s", F.explode(F.array_distinct("f")).alias("x"))
    both = F.coalesce(F.arrays_overlap("s", second), F.lit(False))
    kinds = asked.select(first, second).distinct()
    met = kinds.select(first, second, F.explode(first).alias("x")).join(held, "x").groupBy(first, second, "id").agg(F.max(both).alias("both"))
    met = met.groupBy(first, second).agg(F.count(F.lit(1)).alias("n2"), F.count_if("both").alias("off"))
    said = each(kinds.select(second).distinct(), second).join(m.select("id", F.explode(F.array_distinct("s")).alias("x")), "x")
    said = said.select(second, "id").distinct().groupBy(second).agg(F.count(F.lit(1)).alias("n1"))
    counts = kinds.join(met, [first, second], "left").join(said, second, "left")
    n2, n1 = F.coalesce("n2", F.lit(0)), F.coalesce("n1", F.lit(0)) - F.coalesce("off", F.lit(0))
    counts = counts.select(first, second, F.explode(F.array(F.struct(F.lit(2).alias("grade"), n2.alias("n")), F.struct(F.lit(1).alias("grade"), n1.alias("n")))).alias("c"))
    return asked.join(counts.where("c.n > 0"), [first, second]).select("query_id", "c.grade", "c.n")


def date_grades(queries: DataFrame, memories: DataFrame, days: int = 2) -> DataFrame:
    """Grade 2 on the query's day, 1 within `days` of it (dates; an equi-join on each day in reach)."""
    near = F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("d")
    q = queries.select("query_id", "day", near)
    return q.join(memories.select("id", F.col("day").alias("d")), "d").select("query_id", "id", F.when(F.col("d") == F.col("day"), 2).otherwise(1).alias("grade"))
