"""Session settings the engine relies on, and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_WRITTEN: dict[tuple[str, str], str] = {}


def session(app: str = "modelgauge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir or the context's own. Only a local session without either gets a folder beside its JVM's."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"/tmp/modelgauge-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A folder of its own under the shared one, removed when the application ends."""
    path = f"{checkpoint_root(spark)}/modelgauge/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def save(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write an intermediate table. The shuffle files of this write are removed as it ends, not when the driver happens to collect garbage,
    so a query's disk holds what one step shuffles. A task keeps a file open for each of up to 64 values of `partition_by` (with small row
    groups) instead of sorting its rows by it, which would spill them; with more values Spark sorts. Columns repeat ids and
    texts, which zstd packs into about half of what Spark's default codec needs."""
    writer, more = df.write.mode("errorifexists").option("compression", "zstd"), {}
    if partition_by:
        more = {"spark.sql.maxConcurrentOutputFileWriters": "64"}
        writer = writer.partitionBy(partition_by).option("parquet.block.size", 16 << 20)
    with shuffle_files_go(df.sparkSession, more):
        writer.parquet(path)


@contextmanager
def shuffle_files_go(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """Shuffle files of what is written in this block are removed as the write ends; `more`: settings for the same time."""
    conf = spark.conf
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **(more or {})}
    old = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            conf.unset(key) if value is None else conf.set(key, value)


def written(spark: SparkSession, name: str, build, partition_by: str | None = None) -> DataFrame:
    """A table that several branches or queries read, written once per application and read back.

    Written rather than cached, so a lost executor costs a re-read and the lineage is cut.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        path = new_folder(spark)
        save(build(), path, partition_by)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def is_written(spark: SparkSession, name: str) -> bool:
    return (spark.sparkContext.applicationId, name) in _WRITTEN
