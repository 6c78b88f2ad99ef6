"""File sinks: JSON lines, one-row reports, sorted-key JSON responses, a markdown table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record a line; null fields are left out."""
    rows.write.mode(mode).json(path)


def response(rows: DataFrame) -> DataFrame:
    """(json): each row as JSON with its keys sorted; null fields are left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])).alias("json"))


def error(message: str) -> Column:
    return F.to_json(F.struct(F.lit(message).alias("error")))


def survey(memories: DataFrame, entities_col: str = "entities", tags_col: str = "tags", top: int = 30) -> DataFrame:
    """One row about a corpus: most frequent entities and tags, its number of rows and first and last day."""
    from memoriq.operators.aggregates import top_values

    most = lambda c, name: top_values(memories, c, top).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("name"), x["n"].alias("count"))).alias(name)
    )
    whole = memories.agg(
        F.count(F.lit(1)).alias("n_memories"), F.array(F.min(F.substring("created_at", 1, 10)), F.max(F.substring("created_at", 1, 10))).alias("date_range")
    )
    return whole.crossJoin(most(entities_col, "top_entities")).crossJoin(most(tags_col, "top_tags"))  # three one-row tables


def markdown(rows: DataFrame, order_by: str) -> DataFrame:
    """(markdown): a small report table as one text."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    lines = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("k"), line.alias("l")))).alias("x"))
    return lines.select(F.concat(F.lit(head), F.concat_ws("\n", F.transform("x", lambda r: r["l"]))).alias("markdown"))
