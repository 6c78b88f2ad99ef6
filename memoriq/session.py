"""Session helpers: table access and the shared folder for written tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset and Spark
    runs in this one process (tests) a temporary folder is made once per
    application; on a cluster it is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own_dir.get(sc.applicationId)
        if path is None:
            path = _own_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="memoriq-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return f"{path.rstrip('/')}/memoriq-{sc.applicationId}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no folder."""
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and move it into place, so that readers see the old or the new one."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    fs, t = _fs(spark, tmp)
    out = fs.create(t, True)
    out.write(bytearray(text.encode()))
    out.close()
    # FileContext.rename with OVERWRITE is the atomic replace of Hadoop file systems
    ctx = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    opts = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    opts[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    ctx.rename(t, _fs(spark, path)[1], opts)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


@contextmanager
def shuffles_end(spark: SparkSession):
    """Shuffle files of what runs here go when it has ended, not when the driver collects its garbage: nothing reads them again."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back.

    Unlike an executor's blocks the files outlive a lost executor. They are
    deleted when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # noqa: BLE001 - the session is gone already
        pass


def bounded(df: DataFrame) -> DataFrame:
    """A result whose size the query itself bounds (a top-k, branch budgets): computed once and held as a local table."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def spread(df: DataFrame) -> DataFrame:
    """At least a partition for every core, for work that costs far more than moving its input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def literal(spark: SparkSession, column: Column):
    """The value of a column expression that reads no table."""
    return spark.range(1).select(column.alias("x")).first()["x"]


def uid(col: str | Column) -> Column:
    """The canonical (lower-case) form of a uuid."""
    return F.lower(F.col(col) if isinstance(col, str) else col)


def utc_month(col: str | Column) -> Column:
    """'yyyy-MM' of a timestamp in UTC, whatever the session's time zone."""
    c = F.col(col) if isinstance(col, str) else col
    days = F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")
