"""Date and time functions, in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoriq.functions.scores import as_of_us


def parse_iso(text: Column) -> Column:
    """ISO-8601 with or without fraction, Z or offset; null where it isn't one, so that a filter on it is absent."""
    sound = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.when(text.rlike(r":"), "Z").otherwise("T00:00:00Z")))
    return F.when(sound, zoned.try_cast("timestamp"))


def format_iso(at: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSZ, whatever the session's zone."""
    us = F.unix_micros(at)
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int")), "yyyy-MM-dd")
    ms = F.pmod(F.floor(us / 1000), F.lit(86_400_000))
    part = lambda unit, size, width: F.lpad((F.floor(ms / unit) % size).cast("string"), width, "0")
    return F.concat(day, F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def utc_date(at: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(at) / 86_400_000_000).cast("int"))


def now_fields(spark: SparkSession, as_of) -> DataFrame:
    """One row about a moment in UTC: texts, day and week of year, quarter, seconds. The week is the ISO week."""
    at = F.timestamp_micros(F.lit(as_of_us(as_of)))
    day = utc_date(at)
    return spark.range(1).select(
        format_iso(at).alias("iso8601"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.substring(format_iso(at), 12, 8).alias("time"),
        F.lit("UTC").alias("timezone"),
        F.lit(0).alias("utc_offset_seconds"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        F.dayofyear(day).alias("day_of_year"),
        F.weekofyear(day).alias("week_of_year"),
        F.quarter(day).alias("quarter"),
        F.floor(F.unix_micros(at) / 1_000_000).cast("long").alias("unix_timestamp"),
    )


#: Date forms found in text: ISO, day.month.year, month/day/year and with an English month's name.
DATE_FORMS = [
    (r"\b(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?Z?)?)", None),
    (r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b", "d.M.yyyy"),
    (r"\b(\d{1,2}/\d{1,2}/\d{4})\b", "M/d/yyyy"),
    (r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2},? \d{4})\b", "MMMM d yyyy"),
]


def dates_in(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, matched_text, date): explicit dates in texts. Phrases such as 'last Thursday' aren't resolved."""
    out = None
    for pattern, form in DATE_FORMS:
        found = rows.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))).alias("matched_text"))
        if form is None:
            date = F.substring("matched_text", 1, 10).try_cast("date")
        else:
            date = F.to_date(F.try_to_timestamp(F.replace("matched_text", F.lit(","), F.lit("")), F.lit(form)))
        part = found.select("id", "matched_text", date.alias("date")).where("date IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def time_bucket(rows: DataFrame, at: str = "created_at", week_span_days: int = 60) -> DataFrame:
    """Rows with `bucket`: weeks if all of them span at most `week_span_days`, months otherwise."""
    span = rows.agg(F.datediff(utc_date(F.max(at)), utc_date(F.min(at))).alias("span_days"))
    day = utc_date(F.col(at))
    unit = F.when(F.col("span_days") <= week_span_days, F.date_trunc("week", day)).otherwise(F.date_trunc("month", day))
    return rows.crossJoin(F.broadcast(span)).withColumn("bucket", F.date_format(unit, "yyyy-MM-dd")).drop("span_days")  # one row
