"""Scores of ranked retrieval as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def as_of_us(as_of: datetime | str) -> int:
    """Microseconds since the epoch of a UTC time given as datetime or ISO text."""
    from datetime import timezone

    t = datetime.fromisoformat(as_of.replace("Z", "+00:00")) if isinstance(as_of, str) else as_of
    if t.tzinfo is None:
        t = t.replace(tzinfo=timezone.utc)
    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def recency(at: Column, as_of: datetime | str, half_life_days: float = 30.0) -> Column:
    """0.5 ** (age / half-life); the future counts as now, a null time scores 0."""
    age = F.greatest(F.lit(0.0), (F.lit(as_of_us(as_of)) - F.unix_micros(at)) / F.lit(float(DAY_US)))
    return F.when(at.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), age / F.lit(max(0.001, half_life_days))))


def graph_score(is_seed: Column, shared: Column) -> Column:
    return F.when(is_seed, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / F.lit(3.0)))


def combined(semantic: Column, recent: Column, graph: Column, lexical: Column, weights=(0.55, 0.20, 0.10, 0.15)) -> Column:
    return sum((F.lit(float(w)) * s for w, s in zip(weights, (semantic, recent, graph, lexical), strict=True)), F.lit(0.0))


def adjacency(delta_seconds: Column, window_seconds: float) -> Column:
    return F.lit(1.0) - F.least(F.lit(1.0), delta_seconds / F.lit(float(max(window_seconds, 1))))


def rank_key(score: Column) -> Column:
    """Scores are rounded before ordering, so that summation order can't flip near ties."""
    return F.round(score, 9)
