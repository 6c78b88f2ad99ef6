"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoriq.llm.knn import mutual_pairs, similar_vectors
from memoriq.llm.level import grades, reading_levels
from memoriq.llm.mix import mixture, shares_report
from memoriq.llm.names import link_names, linked_pairs
from memoriq.llm.neardup import all_pairs, duplicate_groups, near_duplicates
from memoriq.llm.pack import assign_containers, packing_report
from memoriq.llm.pii import find_personal, redact_personal
from memoriq.llm.split import split_oversized
from memoriq.session import spread, table, uid, written


def _memories(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per memory: the table repeats rows, with one content."""
    m = table(spark, sf_dir, "memories")
    return m.select(uid("id").alias("id"), *columns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pairs = near_duplicates(_memories(spark, sf_dir, "text"), width=3, threshold=0.5, min_words=12)
    return all_pairs(members, pairs)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of memories by five words and 0.8, with the sources that captured each member."""
    rows = _memories(spark, sf_dir, "text", "source")
    sources = rows.groupBy("id").agg(F.min(F.lower(F.trim("source"))).alias("source"))
    return duplicate_groups(rows).join(sources, "id")


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "entities").withColumn("id", uid("id"))
    return link_names(rows, table(spark, sf_dir, "given_names"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_pairs(p3_entities(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(_memories(spark, sf_dir, "text"))
    return pieces.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select(F.col("id").alias("memory_id")).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(_memories(spark, sf_dir, "text").where(F.char_length("text") > 1800).dropDuplicates(["id"]))
    return pieces.withColumnRenamed("id", "memory_id")


def p4_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized memory put together again from the bodies of its pieces, with its longest piece in bounds and its overlaps near 200."""
    p = p4_pieces(spark, sf_dir)
    body = F.substr("piece", F.col("body_offset") - F.col("start_offset") + 1)
    overlap = F.when(F.col("piece_no") > 0, F.col("body_offset") - F.col("start_offset"))
    one = p.groupBy("memory_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", body.alias("body")))).alias("x"),  # the pieces of one text
        F.max(F.char_length("piece")).alias("longest"),
        F.min(overlap).alias("least"),
        F.max(overlap).alias("most"),
        F.bool_and(F.col("piece_no") < F.col("n_pieces")).alias("numbered"),
    )
    whole = F.md5(F.concat_ws("", F.transform("x", lambda r: r["body"])))
    ok = F.col("numbered") & (F.col("longest") <= 1800) & (F.col("least") >= 0) & (F.col("most") <= 200)
    return one.select("memory_id", whole.alias("text_md5"), ok.alias("in_bounds"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_containers(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p8_containers(spark, sf_dir))


def p8_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: every document is there once, whole unless it exceeds a container, and none is over-full."""
    rows = table(spark, sf_dir, "documents").count()
    a = written(p8_containers(spark, sf_dir), "containers")
    per = a.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    docs = a.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    bad = (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("size") / 2048))) | (F.col("size") != F.col("end"))
    one = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(bad).alias("cut_needlessly"))
    two = per.agg(F.count_if(F.col("used") > 2048).alias("over_full"), F.sum("used").alias("used"), F.count(F.lit(1)).alias("n"))
    # of two containers that are both at most half full one is needless
    half = per.agg((F.count_if(F.col("used") <= 1024) <= F.greatest(F.lit(1), F.ceil(F.lit(rows) / 4096))).alias("tight"))
    return one.crossJoin(two.select("over_full")).crossJoin(half)  # one-row tables


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares_report(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mixture, per target: no document above max_repeats, and the tokens of its share within one document's length."""
    mix = written(p9_mixture(spark, sf_dir), "mixture")
    s = shares_report(mix, table(spark, sf_dir, "mix_targets"))
    one = mix.agg(F.max("n_tokens").alias("longest"), F.sum(F.col("n_tokens") * F.col("copies")).alias("total"))
    near = F.abs(F.col("tokens") - F.col("target_share") * F.col("total")) <= F.col("longest")
    return s.crossJoin(one).select("source", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), near.alias("on_target"))


def p10_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, and the level of those whose raters (two or more) agree."""
    levels = p10_levels(spark, sf_dir)
    agreed = grades(table(spark, sf_dir, "doc_levels")).where("certain").select("doc_id", F.lit(True).alias("agreed"))
    return levels.join(agreed, "doc_id", "left").select("doc_id", "n_words", F.when(F.col("agreed"), F.col("reading_level")).alias("reading_level"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(spread(_memories(spark, sf_dir, "text"))).withColumnRenamed("id", "memory_id").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per memory, its text with placeholders; texts are read once and repeated rows leave after the network."""
    rows = _memories(spark, sf_dir, "text").where(F.col("text").isNotNull())
    return redact_personal(spread(rows)).dropDuplicates(["id"]).withColumnRenamed("id", "memory_id")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "memory_embeddings")
    return rows.select(F.col("profile_safe_id").alias("profile"), uid("memory_id").alias("id"), "embedding", "updated_at")


def p7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar memories of every usable vector, however similar."""
    return similar_vectors(_vectors(spark, sf_dir), k=5, dim=64)


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar memories of each vector, of those with a cosine of 0.9 or more."""
    return similar_vectors(_vectors(spark, sf_dir), k=5, least=0.9, dim=64)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutual_pairs(p7_neighbours(spark, sf_dir))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_levels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).where("n_words >= 40").select("doc_id", "reading_level")


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p3_found": p3_found,
    "p3_entities": p3_entities,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_neighbours": p7_neighbours,
    "p7_nearest": p7_nearest,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p4_rebuilt": p4_rebuilt,
    "p8_sound": p8_sound,
    "p9_sound": p9_sound,
    "p10_graded": p10_graded,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
}

_P7 = """
WITH l AS (
  SELECT profile_safe_id p, lower(memory_id) id, embedding::DOUBLE[] e,
    row_number() OVER (PARTITION BY profile_safe_id, lower(memory_id) ORDER BY updated_at DESC NULLS LAST, embedding DESC NULLS LAST) rn
  FROM memory_embeddings),
v AS (SELECT p, id, e FROM l WHERE rn = 1 AND len(e) = 64 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
c AS (SELECT a.p, a.id, b.id neighbour, CASE WHEN a.e = b.e THEN 1.0 ELSE list_cosine_similarity(a.e, b.e) END cosine, a.e = b.e twin
  FROM v a JOIN v b ON a.p = b.p AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY p, id ORDER BY twin DESC, cosine DESC, neighbour) AS rank FROM c WHERE cosine >= 0.9)
"""

_P1 = """
WITH m AS (SELECT DISTINCT lower(id) id, text FROM memories WHERE text IS NOT NULL),
w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM m),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] s
  FROM (SELECT id, w, unnest(range(1, len(w) - 1)) i FROM w WHERE len(w) >= 12)),
n AS (SELECT id, count(*) n FROM s GROUP BY id),
c AS (SELECT a.id id_a, b.id id_b, count(*) k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
"""

SQL = {
    "p1_found": _P1 + "SELECT id_a, id_b FROM c JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE 2 * k >= a.n + b.n - k",
    "p7_found": _P7 + "SELECT DISTINCT p AS profile_safe_id, least(id, neighbour) id_a, greatest(id, neighbour) id_b FROM r WHERE rank <= 5",
    "p7_neighbours": _P7 + "SELECT p AS profile, id, neighbour, cosine, rank FROM r WHERE rank <= 5",
    "p7_nearest": _P7.replace(" WHERE cosine >= 0.9", "") + "SELECT p AS profile, id, neighbour, cosine, rank FROM r WHERE rank <= 5",
    "p4_rebuilt": "SELECT DISTINCT lower(id) AS memory_id, md5(text) AS text_md5, true AS in_bounds FROM memories WHERE length(text) > 1800",
    "p8_sound": "SELECT count(*) AS n_docs, 0 AS cut_needlessly, 0 AS over_full, true AS tight FROM documents",
    "p9_sound": "SELECT lower(trim(source)) AS source, max_repeats, true AS within_cap, true AS on_target FROM mix_targets",
    "p10_graded": """
WITH l AS (SELECT doc_id, rater, reading_level, row_number() OVER (PARTITION BY doc_id, rater ORDER BY rated_at DESC NULLS LAST, reading_level DESC) rn
  FROM doc_levels WHERE reading_level IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT doc_id, min(reading_level) reading_level FROM l WHERE rn = 1 GROUP BY doc_id HAVING count(*) > 1 AND min(reading_level) = max(reading_level))
SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n_words, reading_level FROM documents LEFT JOIN g USING (doc_id)""",
    "p4_found": "SELECT DISTINCT lower(id) AS memory_id FROM memories WHERE length(text) > 1800",
}
