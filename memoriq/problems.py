"""Queries of the data-care operators (change feeds, references) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from memoriq.operators.changefeed import STATE_TABLES, apply_changes, visible
from memoriq.operators.references import Reference, orphan_references, orphan_report
from memoriq.session import shared_dir, table
from memoriq.store import BucketStore


def p2_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mirrored memories with the change and the payload of their present content, after one publication."""
    target = BucketStore(spark, f"{shared_dir(spark)}/feed-state-{uuid.uuid4().hex}", STATE_TABLES)
    return visible(apply_changes(table(spark, sf_dir, "outbox"), target))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_state(spark, sf_dir).select("record_id", "change_id")


def _references(spark: SparkSession, sf_dir: str):
    mentions, relations = table(spark, sf_dir, "mentions"), table(spark, sf_dir, "relations")
    refs = [
        Reference("mentions", mentions, "memory_id", "memories"),
        Reference("mentions", mentions, "entity_id", "entities"),
        Reference("relations", relations, "provenance_memory_id", "memories"),
    ]
    return refs, {"memories": table(spark, sf_dir, "memories"), "entities": table(spark, sf_dir, "entities")}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*_references(spark, sf_dir))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(*_references(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_state": p2_state, "p5_found": p5_found, "p5_report": p5_report}

_P2 = """
WITH d AS (
  SELECT lower(id) change_id, lower(record_id) record_id, lower(trim(operation)) op, created_at, payload,
    row_number() OVER (PARTITION BY lower(id) ORDER BY coalesce(attempt_count, -1) DESC, arrival_no DESC) rn
  FROM outbox WHERE record_type = 'memory' AND record_id IS NOT NULL AND id IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY created_at NULLS FIRST, change_id) pos
  FROM d WHERE rn = 1 AND op IN ('insert', 'upsert', 'delete', 'update')),
b AS (SELECT record_id, max(pos) base FROM c WHERE op <> 'update' GROUP BY record_id),
l AS (SELECT record_id, max(pos) last FROM c GROUP BY record_id)
SELECT c.record_id, c.change_id{payload}
FROM b JOIN c k ON k.record_id = b.record_id AND k.pos = b.base AND k.op <> 'delete'
JOIN l ON l.record_id = b.record_id JOIN c ON c.record_id = l.record_id AND c.pos = l.last
"""
_P5 = """
WITH refs AS (
  SELECT 'mentions' src_table, lower(id) src_id, 'memory_id' ref_field, lower(memory_id) ref, created_at, 'm' kind FROM mentions
  UNION ALL SELECT 'mentions', lower(id), 'entity_id', lower(entity_id), created_at, 'e' FROM mentions
  UNION ALL SELECT 'relations', lower(id), 'provenance_memory_id', lower(provenance_memory_id), created_at, 'm' FROM relations),
par AS (
  SELECT lower(id) ref, 'm' kind, bool_or(coalesce(tombstoned, false)) dead, min(created_at) made FROM memories GROUP BY 1
  UNION ALL SELECT DISTINCT lower(id), 'e', false, NULL::TIMESTAMPTZ FROM entities),
f AS (
SELECT DISTINCT src_table, src_id, ref_field,
  CASE WHEN par.ref IS NULL THEN 'missing' WHEN dead THEN 'deleted' WHEN made > refs.created_at THEN 'late' END reason,
  strftime(refs.created_at AT TIME ZONE 'UTC', '%Y-%m') year_month
FROM refs LEFT JOIN par ON par.ref = refs.ref AND par.kind = refs.kind WHERE refs.ref IS NOT NULL)
"""
SQL = {
    "p2_found": _P2.format(payload=""),
    "p2_state": _P2.format(payload=", c.payload"),
    "p5_found": _P5 + "SELECT * FROM f WHERE reason IS NOT NULL",
    "p5_report": _P5 + "SELECT src_table, ref_field, reason, year_month, count(*) n_rows FROM f WHERE reason IS NOT NULL GROUP BY ALL",
}
