"""References to records that do not exist: per row and per table and month."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoriq.session import uid, utc_month


@dataclass(frozen=True)
class Reference:
    """A foreign key: `rows.field` of table `name` refers to `parents.id`."""

    name: str
    rows: DataFrame
    field: str
    parent: str


def parent_keys(rows: DataFrame) -> DataFrame:
    """One row per parent id: whether it is tombstoned and when it was created.

    Tables without those columns get false and null. Of repeated parent rows any
    tombstone counts, and the earliest creation.
    """
    dead = F.coalesce("tombstoned", F.lit(False)) if "tombstoned" in rows.columns else F.lit(False)
    made = F.col("created_at") if "created_at" in rows.columns else F.lit(None).cast("timestamp")
    keyed = rows.where(F.col("id").isNotNull()).select(uid("id").alias("ref"), dead.alias("dead"), made.alias("made"))
    return keyed.groupBy("ref").agg(F.max("dead").alias("dead"), F.min("made").alias("made"))


def orphan_references(references: list[Reference], parents: dict[str, DataFrame]) -> DataFrame:
    """Rows whose reference leads nowhere: src_table, src_id, ref_field, reason, year_month.

    Reason is `missing` (no such parent), `deleted` (tombstoned parent) or `late`
    (the parent was created after the referring row). Null references are no
    cases, repeated rows give one case, a null created_at gives a null month and
    is never late.

    Distinct keys with their first use are anti-joined against the parents; only
    the keys at fault are joined back to the referring rows, so the wide side is
    shuffled at most once more (not at all where the faulty keys are few enough to
    broadcast) and a hot key is one row in the check.
    """
    found = []
    for parent in dict.fromkeys(r.parent for r in references):
        refs = None
        for r in (r for r in references if r.parent == parent):
            part = r.rows.where(F.col(r.field).isNotNull()).select(
                F.lit(r.name).alias("src_table"),
                uid("id").alias("src_id"),
                F.lit(r.field).alias("ref_field"),
                uid(r.field).alias("ref"),
                "created_at",
            )
            refs = part if refs is None else refs.unionByName(part)
        keys = refs.groupBy("ref").agg(F.min("created_at").alias("first_use"))
        known = parent_keys(parents[parent])
        missing = keys.join(known, "ref", "left_anti").select(
            "ref", F.lit(False).alias("dead"), F.lit(None).cast("timestamp").alias("made"), F.lit(True).alias("gone")
        )
        suspect = keys.join(known, "ref").where(F.col("dead") | (F.col("made") > F.col("first_use")))
        faulty = missing.unionByName(suspect.select("ref", "dead", "made", F.lit(False).alias("gone")))
        reason = (
            F.when(F.col("gone"), F.lit("missing"))
            .when(F.col("dead"), F.lit("deleted"))
            .when(F.col("made") > F.col("created_at"), F.lit("late"))
        )
        found.append(
            refs.join(faulty, "ref")
            .select("src_table", "src_id", "ref_field", reason.alias("reason"), utc_month("created_at").alias("year_month"))
            .where(F.col("reason").isNotNull())
        )
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def orphan_report(references: list[Reference], parents: dict[str, DataFrame]) -> DataFrame:
    """Counts per table, field, reason and month."""
    return (
        orphan_references(references, parents)
        .groupBy("src_table", "ref_field", "reason", "year_month")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
