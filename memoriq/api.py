"""The engine's calls: remember, recall, recall_around, list_recent, forget, load, relate, traverse, now and parse_date, over a store of snapshots."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoriq.functions import text as X
from memoriq.functions import times as T
from memoriq.functions.enrich import Enricher, WordEnricher, enriched
from memoriq.functions.scores import as_of_us
from memoriq.functions.vectors import vector_of
from memoriq.operators import aggregates as A
from memoriq.operators import branches as B
from memoriq.operators import graph as G
from memoriq.operators import merge as M
from memoriq.plans import recall as R
from memoriq.session import bounded
from memoriq.sources import model as D
from memoriq.store import Catalog

DRAFT = "text string, occurred_at timestamp, source string, conversation_id string, tags array<string>"
SCHEMAS = {
    "memories": D.MEMORY,
    "entities": D.ENTITY,
    "mentions": D.MENTION,
    "relations": D.RELATION,
    "tags": D.TAG,
    "memory_tags": D.MEMORY_TAG,
    "outbox": D.OUTBOX,
    "vectors": D.EMBEDDING,
}


class Engine:
    """One writer, any number of readers. Times are given by the caller; nothing reads the clock but `now()` without argument."""

    def __init__(self, spark: SparkSession, root: str, enricher: Enricher | None = None):
        self.spark, self.enricher = spark, enricher or WordEnricher()
        self.store = Catalog(spark, root, SCHEMAS)

    @property
    def profile_id(self) -> str:
        e = self.enricher
        return self.spark.range(1).select(X.safe_profile_id(F.lit(e.profile), F.lit(e.backend), F.lit(e.dim)).alias("x")).first()["x"]

    # writing -----------------------------------------------------------------------------------------------

    def remember(self, drafts: DataFrame, at) -> DataFrame:
        """Enrich and store drafts (DRAFT) in one commit: memories, entities, mentions, tags, vectors and an outbox row each. Returns (id, language, n_entities).

        Drafts without text are refused. Names keep the spelling that came first.
        """
        if drafts.where(F.coalesce(F.trim("text"), F.lit("")) == "").limit(1).count():
            raise ValueError("text must not be empty")
        now = F.timestamp_micros(F.lit(as_of_us(at)))
        batch = uuid.uuid4().hex
        rows = enriched(drafts, self.enricher).withColumn("_n", F.monotonically_increasing_id())
        rows = rows.withColumn("id", X.named_uuid(F.col("_n").cast("string"), f"memoriq:{batch}:")).withColumns({"created_at": now, "metadata": F.lit("{}"), "tombstoned": F.lit(False)})
        rows = self._held(rows.drop("_n"))
        each = rows.select(F.col("id").alias("memory_id"), "text", F.explode("found").alias("f")).select("memory_id", "text", "f.value", "f.entity_type")
        known = self.store.read("entities")
        new = each.select(F.col("value").alias("canonical_name"), "entity_type").distinct().withColumn("id", X.named_uuid(F.concat_ws("|", F.lower("canonical_name"), "entity_type"), "memoriq:entity:"))
        fresh = M.first_spelling(new, [F.col("canonical_name")]).select("id", "canonical_name", "entity_type", F.lit(None).cast("array<string>").alias("aliases"))
        taken = known.select(F.lower("canonical_name").alias("key"), "entity_type")
        fresh = fresh.withColumn("key", F.lower("canonical_name")).join(taken, ["key", "entity_type"], "left_anti").select(*known.columns)
        entities = known.unionByName(fresh)
        named = entities.select(F.col("id").alias("entity_id"), F.lower("canonical_name").alias("key"), "entity_type")
        # every place of a name, 0-based
        places = F.filter(F.sequence(F.lit(0), F.char_length("text") - F.char_length("value")), lambda i: F.substr("text", i + 1, F.char_length("value")) == F.col("value"))
        placed = each.where(F.char_length("text") >= F.char_length("value")).withColumn("start", F.explode(places))
        mentions = placed.withColumn("key", F.lower("value")).join(named, ["key", "entity_type"]).select(
            X.named_uuid(F.concat_ws("|", "memory_id", "entity_id", F.col("start").cast("string")), "memoriq:mention:").alias("id"), "memory_id", "entity_id",
            F.col("start").cast("long").alias("start_offset"), (F.col("start") + F.char_length("value")).cast("long").alias("end_offset"), now.alias("created_at"),
        )
        tagged = rows.select(F.col("id").alias("memory_id"), F.explode("tags").alias("name"))
        old_tags = self.store.read("tags")
        tags = M.insert_missing(old_tags, tagged.select(X.named_uuid(F.col("name")).alias("id"), "name"), ["name"])
        links = tagged.join(tags.withColumnRenamed("id", "tag_id"), "name").select("memory_id", "tag_id").distinct()
        vectors = rows.where("embedding IS NOT NULL").select(F.lit(self.profile_id).alias("profile_safe_id"), F.col("id").alias("memory_id"), "embedding", now.alias("updated_at"))
        payload = F.to_json(F.struct("source", "language", "sentiment", "conversation_id"))
        outbox = rows.select(
            X.named_uuid(F.col("id"), "memoriq:outbox:").alias("id"), F.lit("memory").alias("record_type"), F.col("id").alias("record_id"), F.lit("upsert").alias("operation"),
            payload.alias("payload"), "created_at", *[F.lit(None).cast(t).alias(c) for c, t in (("sent_at", "timestamp"), ("last_attempt_at", "timestamp"), ("last_error", "string"))],
            F.lit(0).alias("attempt_count"),
        )
        new_tags = tags.join(old_tags.select("name"), "name", "left_anti").select(*tags.columns)
        self.store.commit({"memories": rows, "entities": fresh, "mentions": mentions, "tags": new_tags, "memory_tags": links, "vectors": vectors, "outbox": outbox})
        return rows.select("id", "language", F.size("found").alias("n_entities"))

    def _held(self, rows: DataFrame) -> DataFrame:
        from memoriq.session import written

        return written(rows, "drafts")

    def forget(self, ids: list[str]) -> list[str]:
        """Tombstone memories; returns the ids that exist. Doing it again is no error."""
        gone = self.spark.createDataFrame([(i.lower(),) for i in ids], "id string")
        memories = self.store.read("memories")
        found = [r["id"] for r in memories.join(gone, "id", "left_semi").select("id").collect()]  # at most the ids asked for
        if found:
            self.store.commit(memories=M.soft_deleted(memories, gone))
        return found

    def relate(self, rows: DataFrame) -> None:
        """Add relations (RELATION); those with a known id are left as they are."""
        self.store.commit(relations=M.insert_missing(self.store.read("relations"), rows, ["id"]))

    def mark(self, log: DataFrame) -> None:
        """Record what became of outbox rows: (id, at, error)."""
        self.store.commit(outbox=M.with_status(self.store.read("outbox"), log))

    # reading -----------------------------------------------------------------------------------------------

    def _vectors(self) -> DataFrame:
        return self.store.read("vectors").where(F.col("profile_safe_id") == self.profile_id).select("memory_id", "embedding")

    def _vector_of(self, query: str):
        if not self.enricher.dim:
            return None
        return vector_of(self.spark.range(1).select(self.enricher.embedding(F.lit(query)).alias("v")).first()["v"])

    def recall(self, query: str, options: R.Options) -> tuple[DataFrame, str]:
        """(hits, path): the hybrid query, or the local one where no branch finds anything."""
        if not query.strip():
            raise ValueError("query must not be empty")
        s, q = self.store.read, self._vector_of(query)
        found = R.seeds(s("memories"), self._vectors(), s("mentions"), s("entities"), q, X.query_tokens(F.lit(query)), X.entity_candidates(F.lit(query)), options)
        if found.isEmpty():
            zero = q if q is not None else F.array().cast("array<double>")
            return R.recall_local(s("memories"), self._vectors(), zero, options, options.weights[:2]), "local"
        rows = R.rerank(G.expanded(found, s("mentions")), s("memories"), self._vectors(), q, options)
        return R.ordered(rows, options.k), "hybrid"

    def diagnose(self, query: str, options: R.Options) -> DataFrame:
        """How many memories each branch finds, and how many together."""
        s = self.store.read
        names = X.entity_candidates(F.lit(query))
        return B.branch_counts(R.seeds(s("memories"), self._vectors(), s("mentions"), s("entities"), self._vector_of(query), X.query_tokens(F.lit(query)), names, options))

    def recall_around(self, window_seconds: float = 86_400, k: int = 10, anchor_id: str | None = None, anchor_at=None) -> DataFrame:
        """By an anchor memory (tombstoned or not), or a time where the id is unknown; with neither nothing is found."""
        if anchor_id is None and anchor_at is None:
            raise ValueError("an anchor is needed")
        memories = self.store.read("memories")
        anchor = None
        if anchor_id is not None:
            anchor = bounded(memories.where(F.col("id") == anchor_id.lower()).select(F.coalesce("occurred_at", "created_at").alias("at")).limit(1))
        if anchor is None or (anchor.isEmpty() and anchor_at is not None):
            anchor = self.spark.range(1).select(F.timestamp_micros(F.lit(as_of_us(anchor_at))).alias("at"))
        return R.recall_around(memories, anchor, window_seconds, k)

    def list_recent(self, as_of, limit: int = 25) -> DataFrame:
        return R.list_recent(self.store.read("memories"), R.Options(as_of=as_of), limit)

    def load(self, memory_id: str) -> DataFrame:
        """One memory with its tags and mentions (those whose entity is gone left out)."""
        s = self.store.read
        one = s("memories").where(F.col("id") == memory_id.lower())
        tags = s("memory_tags").join(s("tags").withColumnRenamed("id", "tag_id"), "tag_id").groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("tags"))
        seen = G.with_entities(s("mentions").where(F.col("memory_id") == memory_id.lower()), s("entities"))
        seen = seen.groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start_offset", "end_offset", "canonical_name", "entity_type"))).alias("mentions"))
        return one.join(tags, "id", "left").join(seen, "id", "left")

    def traverse(self, start: DataFrame, hops: int = 2) -> DataFrame:
        return G.traverse(self.store.read("relations"), start, hops)

    def outbox_stats(self) -> DataFrame:
        return A.outbox_stats(self.store.read("outbox"))

    def next_batch(self, limit: int = 100) -> DataFrame:
        return A.next_batch(self.store.read("outbox"), limit)

    def now(self, at=None) -> DataFrame:
        return T.now_fields(self.spark, at or datetime.now(timezone.utc))

    def parse_date(self, text: str) -> DataFrame:
        return T.dates_in(self.spark.createDataFrame([(0, text)], "id int, text string")).select("matched_text", "date")
