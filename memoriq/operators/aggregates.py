"""Aggregations over memories, mentions and the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_values(rows: DataFrame, array_col: str, n: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(rank, value, n): the most frequent elements of an array column, ties by value. Counted before anything is ranked."""
    each = rows.select(F.explode(array_col).alias("value"))
    if exclude:
        each = each.where(~F.col("value").isin(*exclude))
    counts = each.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)
    return counts.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "value")).alias("rank"), "value", "n")


def outbox_stats(outbox: DataFrame) -> DataFrame:
    """Rows not sent: number, oldest creation (seconds), the oldest row's error, attempts of all."""
    pending = outbox.where(F.col("sent_at").isNull())
    oldest = F.min(F.struct(F.col("created_at").isNull(), "created_at", "id", "last_error"))
    return pending.agg(
        F.count(F.lit(1)).alias("pending"),
        F.unix_micros(F.min("created_at")).alias("oldest_us"),
        oldest["last_error"].alias("last_error"),
        F.coalesce(F.sum("attempt_count"), F.lit(0)).alias("attempts"),
    )


def next_batch(outbox: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest rows not sent, ties by id."""
    return outbox.where(F.col("sent_at").isNull()).orderBy("created_at", "id").limit(max(1, limit))


def latency_stats(samples: DataFrame, value: str = "ms", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, nearest-rank percentiles (place round((n - 1) p)), extremes and population deviation.

    Ranks come from counts of equal values, not from a gathered list: a group is
    as large as it has distinct values.
    """
    per = samples.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    up_to = F.sum("k").over(Window.partitionBy(*by).orderBy("v")) if by else F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("v"))
    whole = F.sum("k").over(Window.partitionBy(*by)) if by else F.sum("k").over(Window.partitionBy(F.lit(0)))
    ranked = per.withColumn("upto", up_to).withColumn("whole", whole)
    at = lambda p: F.floor((F.col("whole") - 1) * p + 0.5)
    pick = lambda p: F.min(F.when(F.col("upto") > at(p), F.col("v")))
    mean = F.sum(F.col("v") * F.col("k")) / F.sum("k")
    return ranked.groupBy(*by).agg(
        F.sum("k").alias("count"),
        F.round(mean, 6).alias("mean"),
        pick(0.50).alias("p50"),
        pick(0.95).alias("p95"),
        pick(0.99).alias("p99"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("v") * F.col("v") * F.col("k")) / F.sum("k") - mean * mean)), 4).alias("stdev"),
    )


def sampled_days(rows: DataFrame, day: Column, n: int = 6) -> DataFrame:
    """(place, day): up to n of the distinct days, every (number of days // n)-th from the first."""
    days = rows.where(day.isNotNull()).select(day.alias("day")).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("day")  # distinct days: a few thousand for any span of texts
    placed = days.select("day", (F.row_number().over(order) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("whole"))
    stride = F.greatest(F.lit(1), F.floor(F.col("whole") / n))
    return placed.where((F.col("at") % stride == 0) & (F.col("at") / stride < n)).select((F.col("at") / stride).cast("int").alias("place"), "day")


def folder_survey(notes: DataFrame, folder: str = "source", at: str = "created_at") -> DataFrame:
    """Rows, first and last time of each folder."""
    return notes.groupBy(F.lower(F.trim(folder)).alias("folder")).agg(
        F.count(F.lit(1)).alias("n"), F.unix_micros(F.min(at)).alias("first_us"), F.unix_micros(F.max(at)).alias("last_us")
    )
