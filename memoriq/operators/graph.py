"""The graph of memories, entities and relations: one-hop expansion and k-hop traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoriq.session import written


def neighbours(seeds: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, shared): memories that share an entity with a seed, seeds left out, with the number of their mentions of seed entities."""
    seed_entities = mentions.join(seeds.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").where("entity_id IS NOT NULL").select("entity_id").distinct()
    near = mentions.join(seed_entities, "entity_id", "left_semi").groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("shared"))
    return near.join(seeds.select("id"), "id", "left_anti")


def expanded(seeds: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, is_seed, shared, semantic, lexical, branches): seeds and their neighbours; a seed's shared count is 0."""
    own = seeds.select("id", F.lit(True).alias("is_seed"), F.lit(0).cast("long").alias("shared"), "semantic", "lexical", "branches")
    near = neighbours(seeds, mentions).select(
        "id", F.lit(False).alias("is_seed"), "shared", F.lit(None).cast("double").alias("semantic"), F.lit(0.0).alias("lexical"),
        F.array().cast("array<string>").alias("branches"),
    )
    return own.unionByName(near)


def with_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions with their entity's name and type; those that lead nowhere are dropped."""
    e = entities.select(F.col("id").alias("entity_id"), "canonical_name", "entity_type")
    return mentions.join(e, "entity_id")


def traverse(relations: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(entity_id, hop): entities within `hops` relations of the start entities, either way, at their least distance."""
    ways = relations.select(F.col("subject_entity_id").alias("a"), F.col("object_entity_id").alias("b"))
    ways = ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached = start.select("entity_id", F.lit(0).alias("hop")).distinct()
    rim = reached
    for hop in range(1, hops + 1):
        step = ways.join(rim.select(F.col("entity_id").alias("a")), "a", "left_semi").select(F.col("b").alias("entity_id")).distinct()
        rim = written(step.join(reached, "entity_id", "left_anti").select("entity_id", F.lit(hop).alias("hop")), "hop")
        reached = reached.unionByName(rim)
    return reached
