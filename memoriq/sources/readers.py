"""File sources: JSON lines, text corpora, note folders, commit logs, verified model files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoriq.functions.text import capitalised_entities, commit_tags, note_id, sections, title_of
from memoriq.sources.model import EVAL_MEMORY, EVAL_QUERY


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped, broken ones give nulls."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(memories, queries) of an evaluation corpus."""
    return read_jsonl(spark, f"{folder}/memories.jsonl", EVAL_MEMORY), read_jsonl(spark, f"{folder}/queries.jsonl", EVAL_QUERY)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of a text file as `text`."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text != ''")


def read_notes(spark: SparkSession, root: str, skip: tuple[str, ...] = ("node_modules", ".git")) -> DataFrame:
    """(path, filename, title, note_id, text) of the markdown files under `root`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = root if ":" in root else f"file:{root}"
    for s in skip:
        files = files.where(~F.contains("path", F.lit(f"/{s}/")))
    relative = F.regexp_replace("path", rf"^{base.rstrip('/')}/+", "")
    rows = files.select(relative.alias("path"), F.substring_index("path", "/", -1).alias("filename"), F.decode("content", "UTF-8").alias("text"))
    return rows.select("path", "filename", title_of(F.col("text"), F.col("filename")).alias("title"), note_id(F.col("path")).alias("note_id"), "text")


def note_sections(notes: DataFrame) -> DataFrame:
    return sections(notes, "note_id", "text").withColumnRenamed("id", "note_id")


def read_commits(spark: SparkSession, log_path: str, files_path: str | None = None, limit: int = 600) -> DataFrame:
    """Commits as memories from a log dump of NUL-separated records.

    A record holds sha, ISO date, subject and body, each on its own line (the body
    may go on). `files_path` is a dump of the shas, each before its file names.
    """
    text = spark.read.text(log_path, lineSep="\x00")  # a record is a line here, so that a long log splits
    records = text.select(F.regexp_replace("value", r"^\s+", "").alias("r")).where("r != ''")
    parts = F.split("r", "\n", 4)
    commits = records.select(
        *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("sha", "date", "subject"))], F.trim(F.coalesce(F.get(parts, F.lit(3)), F.lit(""))).alias("body")
    )
    if files_path:
        dump = spark.read.text(files_path, lineSep="\x00")
        blocks = dump.select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\n+").alias("l")).where(F.get("l", F.lit(0)) != "")
        files = blocks.select(F.col("l")[0].alias("sha"), F.filter(F.slice("l", 2, 1_000_000), lambda f: f != "").alias("files"))
        commits = commits.join(files, "sha", "left")
    else:
        commits = commits.withColumn("files", F.lit(None).cast("array<string>"))
    whole = F.substring(F.when(F.col("body") != "", F.concat_ws("\n", "subject", "body")).otherwise(F.col("subject")), 1, limit)
    return commits.select(
        F.concat(F.lit("m"), F.substring("sha", 1, 8)).alias("id"),
        whole.alias("text"),
        F.col("date").alias("created_at"),
        F.col("date").alias("occurred_at"),
        F.lit("git").alias("source"),
        commit_tags(F.col("subject"), F.col("files")).alias("tags"),
        capitalised_entities(whole).alias("entities"),
    )


def verified_files(spark: SparkSession, folders: list[str], checksums: dict[str, str]) -> DataFrame:
    """(file, folder, ok) of a model's files: in the first folder that has it, by SHA-256. A missing file has a null folder and is not ok."""
    wanted = spark.createDataFrame(sorted(checksums.items()), "file string, sha256 string")
    found = None
    for rank, folder in enumerate(folders):
        content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(folder)
        part = content.select(F.substring_index("path", "/", -1).alias("file"), F.lit(rank).alias("rank"), F.lit(folder).alias("folder"), F.sha2("content", 256).alias("got"))
        found = part if found is None else found.unionByName(part)
    first = found.groupBy("file").agg(F.min_by(F.struct("folder", "got"), "rank").alias("f"))
    return wanted.join(first, "file", "left").select("file", F.col("f.folder").alias("folder"), F.coalesce(F.col("f.got") == F.col("sha256"), F.lit(False)).alias("ok"))
