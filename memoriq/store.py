"""Versioned Parquet snapshots with an atomically replaced pointer.

A snapshot is a folder `v=<n>-<random>`; `_CURRENT` names the live one. A reader
resolves the pointer once and then reads files that never change, so a table
may be rebuilt from itself.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoriq.session import list_names, read_text, remove_path, write_text


class SnapshotTable:
    """A keyed table of immutable snapshots. Single writer, any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """Number of the live snapshot, 0 if nothing was published."""
        name = read_text(self.spark, f"{self.root}/_CURRENT")
        return int(name.split("=")[1].split("-")[0]) if name else 0

    def path(self) -> str | None:
        name = read_text(self.spark, f"{self.root}/_CURRENT")
        return f"{self.root}/{name}" if name else None

    def read(self, schema=None) -> DataFrame | None:
        """The live rows; None (or an empty table of `schema`) before the first publication."""
        path = self.path()
        if path is None:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(path) if schema is None else self.spark.read.schema(schema).parquet(path)

    def publish(self, df: DataFrame, keep_previous: bool = True, partition_by: list[str] | None = None) -> DataFrame:
        """Write `df` whole, then make it the live snapshot in one rename."""
        old = self.path()
        name = f"v={self.version() + 1}-{uuid.uuid4().hex[:8]}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{name}")
        write_text(self.spark, f"{self.root}/_CURRENT", name)
        if old and not keep_previous:
            remove_path(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")


class BucketStore:
    """Keyed tables in hash buckets that change together.

    `_CURRENT` maps every bucket of every table to its folder. A commit writes only
    the buckets it touches and replaces the pointer in one rename, so readers see
    all of it or nothing. Folders of the last `keep` versions stay for readers that
    resolved the pointer earlier; `vacuum` deletes older ones. Where buckets grow
    over `most_rows` (see `fit`), all tables are rewritten with more of them.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, str]], buckets: int = 16, most_rows: int = 500_000):
        self.spark, self.root, self.tables, self.least, self.most_rows = spark, root.rstrip("/"), tables, buckets, most_rows

    def _live(self) -> dict:
        text = read_text(self.spark, f"{self.root}/_CURRENT")
        return json.loads(text) if text else {"version": 0, "buckets": self.least, "tables": {}, "before": [], "note": {}}

    def version(self) -> int:
        return self._live()["version"]

    def note(self) -> dict:
        return self._live()["note"]

    def buckets(self) -> int:
        return self._live()["buckets"]

    def bucket(self, name: str, n: int | None = None) -> Column:
        """The bucket of a row of `name`."""
        return F.pmod(F.xxhash64(self.tables[name][0]), F.lit(n or self._live()["buckets"])).cast("int")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """Buckets of `name` in which `rows` have a key: at most as many as there are buckets."""
        return sorted(r["b"] for r in rows.select(self.bucket(name).alias("b")).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        folders = self._live()["tables"].get(name, {})
        paths = [f"{self.root}/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        schema = self.tables[name][1]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, changed: dict[str, tuple[DataFrame, list[int] | None]], note: dict | None = None, keep: int = 2, buckets: int | None = None) -> int:
        """Write the touched buckets (all if None) of each table from its rows, then make them live at once."""
        live = self._live()
        version, n = live["version"] + 1, buckets or live["buckets"]
        tables = {k: dict(v) for k, v in live["tables"].items()}
        for name, (rows, touched) in changed.items():
            folder = f"{name}/v={version}-{uuid.uuid4().hex[:8]}"
            rows.withColumn("_bucket", self.bucket(name, n)).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            old = {} if touched is None else {b: f for b, f in tables.get(name, {}).items() if int(b) not in touched}
            found = [x.split("=")[1] for x in list_names(self.spark, f"{self.root}/{folder}") if x.startswith("_bucket=")]
            tables[name] = old | {b: f"{folder}/_bucket={b}" for b in found}
        before = [live["tables"], *live["before"]][:keep]
        text = {"version": version, "buckets": n, "tables": tables, "before": before, "note": live["note"] | (note or {})}
        write_text(self.spark, f"{self.root}/_CURRENT", json.dumps(text))
        return version

    def fit(self, name: str, more: int) -> None:
        """Enough buckets for the live rows of `name` and `more`."""
        n = live = self._live()["buckets"]
        rows = self.read(name).count() + more  # from the files' footers
        while n * self.most_rows < rows:
            n *= 2
        if n > live:
            self.commit({k: (self.read(k), None) for k in self.tables if k in self._live()["tables"]}, buckets=n)

    def vacuum(self) -> None:
        """Delete folders that neither the live version nor the kept ones use."""
        live = self._live()
        used = {f for tables in (live["tables"], *live["before"]) for folders in tables.values() for f in folders.values()}
        for name in self.tables:
            for folder in list_names(self.spark, f"{self.root}/{name}"):
                inner = [f"{name}/{folder}/{b}" for b in list_names(self.spark, f"{self.root}/{name}/{folder}") if b.startswith("_bucket=")]
                if not used.intersection(inner):
                    remove_path(self.spark, f"{self.root}/{name}/{folder}")
                else:
                    for f in set(inner) - used:
                        remove_path(self.spark, f"{self.root}/{f}")


class Catalog:
    """Several tables that change together: `_CURRENT` maps each to its folders and is replaced in one rename."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def _live(self) -> dict:
        text = read_text(self.spark, f"{self.root}/_CURRENT")
        return json.loads(text) if text else {"version": 0, "tables": {}}

    def version(self) -> int:
        return self._live()["version"]

    def read(self, name: str) -> DataFrame:
        folders = self._live()["tables"].get(name)
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.root}/{f}" for f in folders])

    def commit(self, appended: dict[str, DataFrame] | None = None, most_folders: int = 200, **changed: DataFrame) -> int:
        """Write new rows of `appended` tables and the `changed` ones whole, then make all of them live at once. Returns the new version.

        A table of more than `most_folders` appended parts is written whole again.
        """
        live = self._live()
        version = live["version"] + 1
        tables = dict(live["tables"])
        appended = dict(appended or {})
        for name in [n for n in appended if len(tables.get(n, [])) >= most_folders]:
            new = appended.pop(name)
            changed[name] = self.read(name).unionByName(new.select(*self.read(name).columns))
        for name, df in (appended | changed).items():
            folder = f"{name}/v={version}-{uuid.uuid4().hex[:8]}"
            shape = self.spark.createDataFrame([], self.schemas[name]).schema
            df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in shape]).write.parquet(f"{self.root}/{folder}")
            tables[name] = [*tables.get(name, []), folder] if name in appended else [folder]
        write_text(self.spark, f"{self.root}/_CURRENT", json.dumps({"version": version, "tables": tables}))
        return version
