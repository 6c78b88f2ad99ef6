"""Structured filters as predicates; unset ones are absent, so that nothing but what is asked reaches the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoriq.functions.scores import as_of_us


@dataclass(frozen=True)
class Filters:
    """Bounds are UTC times (ISO text or datetime), inclusive."""

    since: object = None
    until: object = None
    source: str | None = None
    conversation_id: str | None = None
    tags: tuple[str, ...] = ()


def moment(at) -> Column:
    return F.timestamp_micros(F.lit(as_of_us(at)))


def effective_time() -> Column:
    return F.coalesce("occurred_at", "created_at")


def time_bounds(f: Filters) -> list[Column]:
    """Bounds of the effective time, written on the stored columns so that they reach the scan."""
    o, c, out = F.col("occurred_at"), F.col("created_at"), []
    if f.since is not None:
        out.append((o >= moment(f.since)) | (o.isNull() & (c >= moment(f.since))))
    if f.until is not None:
        out.append((o <= moment(f.until)) | (o.isNull() & (c <= moment(f.until))))
    return out


def lax_time_bounds(f: Filters) -> list[Column]:
    """Either time may satisfy each bound."""
    o, c, out = F.col("occurred_at"), F.col("created_at"), []
    if f.since is not None:
        out.append((o >= moment(f.since)) | (c >= moment(f.since)))
    if f.until is not None:
        out.append((o <= moment(f.until)) | (c <= moment(f.until)))
    return out


def within_window(at: Column, seconds: float) -> Column:
    w = F.make_dt_interval(secs=F.lit(float(seconds)))
    return F.col("occurred_at").between(at - w, at + w) | F.col("created_at").between(at - w, at + w)


def equalities(f: Filters) -> list[Column]:
    out = [F.col("source") == f.source] if f.source is not None else []
    return out + ([F.col("conversation_id") == f.conversation_id] if f.conversation_id is not None else [])


def any_tag(f: Filters, tags: Column) -> list[Column]:
    return [F.arrays_overlap(tags, F.array(*[F.lit(t) for t in f.tags]))] if f.tags else []


def apply(rows: DataFrame, predicates: list[Column]) -> DataFrame:
    return rows.where(reduce(and_, predicates)) if predicates else rows


def alive(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("tombstoned").isNull() | ~F.col("tombstoned"))


def filtered(memories: DataFrame, f: Filters, tags: Column | None = None, lax: bool = False) -> DataFrame:
    """Live memories within all filters."""
    bounds = lax_time_bounds(f) if lax else time_bounds(f)
    return apply(alive(memories), bounds + equalities(f) + (any_tag(f, tags) if tags is not None else []))
