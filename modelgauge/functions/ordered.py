"""Places of rows in an order, for keys of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelgauge.plans.session import new_folder, remove_folder, save


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to a new folder of the shared one and read it back: values of non-deterministic columns are fixed, lineage is cut."""
    path = new_folder(df.sparkSession)
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """`stored` for tables that nothing reads after this block: their folders go as it ends."""
    folders = []

    def store(df: DataFrame) -> DataFrame:
        folders.append(new_folder(spark))
        save(df, folders[-1])
        return spark.read.schema(df.schema).parquet(folders[-1])

    try:
        yield store
    finally:
        for path in folders:
            remove_folder(spark, path)


def same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs."""
    out = F.lit(True)
    for a, b in pairs:
        out &= left[a].eqNullSafe(right[b])
    return out


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """`df` with pos, the place from 0 among the rows of the same `keys` in `order`, and n, the number of those rows.

    One range exchange puts all rows in order, so that a key with any share of the rows spreads over many tasks; places inside a
    partition are turned into places inside the key by the counts of each (key, partition). A null key is a key. Rows are written once.
    """
    along = [*(F.col(k).asc_nulls_first() for k in keys), *order]
    rows = df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_at", F.monotonically_increasing_id())
    rows = store(rows).withColumn("_part", F.shiftrightunsigned("_at", 33))
    seams = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    every = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = F.coalesce(F.sum("_rows").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seams = seams.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), (earlier - F.col("_first")).alias("_shift"), F.sum("_rows").over(every).alias("n"))
    placed = rows.join(seams, same(rows, seams, [*((k, f"_k{i}") for i, k in enumerate(keys)), ("_part", "_p")]))
    return placed.select(*df.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")
