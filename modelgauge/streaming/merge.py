"""Tables kept up to date by micro-batches: rows live in buckets of their key, a batch rewrites only the buckets it touches.

Layout under the table's folder: data/batch=<n>/bucket=<b> holds the rows of bucket b as batch n left them, ledger/batch=<n> says for
every bucket which batch wrote it last. The ledger entry is written after the data, so a reader sees a batch whole or not at all, and
a batch that runs again starts from the entry before it and overwrites its own folders: nothing is lost or taken twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

BUCKETS = 64
Combine = Callable[[DataFrame, DataFrame], DataFrame]


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The last batch (before `before`) whose ledger entry is complete."""
    folder, fs = _folder(spark, f"{path}/ledger")
    if not fs.exists(folder):
        return None
    names = (re.fullmatch(r"batch=(\d+)", f.getPath().getName()) for f in fs.listStatus(folder))
    found = [int(m[1]) for m in names if m and fs.exists(_folder(spark, f"{path}/ledger/{m[0]}/_SUCCESS")[0])]
    return max((b for b in found if before is None or b < before), default=None)


def _versions(spark: SparkSession, path: str, batch: int | None) -> dict[int, int]:
    """bucket -> batch that wrote it last; as many entries as there are buckets at most."""
    if batch is None:
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{path}/ledger/batch={batch}").collect()}


def _rows(spark: SparkSession, path: str, versions: dict[int, int], schema: str) -> DataFrame:
    _, fs = _folder(spark, path)
    folders = [f"{path}/data/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
    folders = [f for f in folders if fs.exists(_folder(spark, f)[0])]  # a bucket may have lost all its rows
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], combine: Combine, schema: str, buckets: int = BUCKETS) -> None:
    """Put a batch into the table: the new rows of the touched buckets are combine(their stored rows, the batch).

    `combine` must keep rows in the bucket of their `keys`. `schema` is the table's.
    """
    spark = batch.sparkSession
    versions = _versions(spark, path, _committed(spark, path, batch_id))
    arrived = f"{path}/arrived/batch={batch_id}"
    batch.write.mode("overwrite").parquet(arrived)  # taken once from the source
    batch = spark.read.schema(batch.schema).parquet(arrived)
    touched = sorted(r[0] for r in batch.select(bucket_of(keys, buckets)).distinct().collect())  # bucket numbers
    stored = _rows(spark, path, {b: versions[b] for b in touched if b in versions}, schema)
    merged = combine(stored, batch).withColumn("bucket", bucket_of(keys, buckets))
    merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={batch_id}")
    ledger = sorted({**versions, **dict.fromkeys(touched, batch_id)}.items())
    spark.createDataFrame(ledger, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}")
    _drop_old(spark, path, batch_id, set(dict(ledger).values()) | set(versions.values()))


def _drop_old(spark: SparkSession, path: str, batch_id: int, used: set[int]) -> None:
    """Delete what neither this batch's ledger entry nor the one before it names; the batch before stays for a second try of this one."""
    previous = _committed(spark, path, batch_id)
    for kind, kept in (("data", used), ("arrived", set()), ("ledger", {previous})):
        folder, fs = _folder(spark, f"{path}/{kind}")
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            m = re.fullmatch(r"batch=(\d+)", f.getPath().getName())
            if m and int(m[1]) < batch_id and int(m[1]) not in kept:
                fs.delete(f.getPath(), True)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as the last complete batch left it."""
    return _rows(spark, path, _versions(spark, path, _committed(spark, path)), schema)


def merged_into(rows: DataFrame, path: str, keys: Sequence[str], combine: Combine, schema: str, checkpoint: str) -> DataStreamWriter:
    """Writer that merges a stream of rows into the table at `path`, in update mode."""
    sink = lambda batch, batch_id: merge(batch, batch_id, path, keys, combine, schema)
    return rows.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
