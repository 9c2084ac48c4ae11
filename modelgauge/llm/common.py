"""Helpers of the operators in this subpackage: shared folder, Arrow text access, polynomial digests."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MASK63 = (1 << 63) - 1
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir). Only a local session without the setting gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="modelgauge-llm-"))
    return _LOCAL[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str], name: str) -> DataFrame:
    """Columns `keep` (they hold `keys`) with pos, the place from 0 among the rows of the same `keys` in `order`, and n, the number of those rows.

    One range exchange puts all rows in order, so that a key with any share of the rows spreads over many tasks; places inside a partition
    are turned into places inside the key by the counts of each (key, partition). A null key is a key. The rows are written once.
    """
    along = [*(F.col(k).asc_nulls_first() for k in keys), *order]
    rows = df.repartitionByRange(*along).sortWithinPartitions(*along).select(*keep, F.monotonically_increasing_id().alias("_at"))
    rows = stored(rows, name).withColumn("_part", F.shiftrightunsigned("_at", 33))
    seams = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = F.coalesce(F.sum("_rows").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seams = seams.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), (earlier - F.col("_first")).alias("_shift"), F.sum("_rows").over(every).alias("n"))
    same = rows["_part"] == seams["_p"]
    for k in keys:
        same &= rows[k].eqNullSafe(seams[f"_{k}"])
    return rows.join(seams, same).select(*keep, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def extended(df: DataFrame, more: str) -> StructType:
    """Schema of `df` followed by the columns of the DDL string `more`."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that `column` holds about `limit` bytes at most in each part (a longer single text stays whole)."""
    col = batch.column(column)
    if not len(col):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
    begin = 0
    while begin < len(col):
        base = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null counts as empty."""
    col = pc.fill_null(col, "")
    flat = pa.array(col.to_pylist(), pa.large_string()) if col.offset and not col.nbytes else col
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int32 if flat.type == pa.string() else np.int64)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2], dtype=np.uint8) if flat.buffers()[2] is not None and flat.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def table_of_bytes(seed: int) -> np.ndarray:
    """A pseudo-random 64-bit value for each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([seed, b]), digest_size=8).digest(), "little") for b in range(256)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


MULTIPLIER = 0x5851F42D4C957F2D
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class RollingDigest:
    """Digests of any run of tokens from prefix sums of a polynomial modulo 2**64 over their randomised values (`table`: a value for each byte)."""

    def __init__(self, data: np.ndarray, table: np.ndarray | None = None):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data if table is None else table[data]) * powers(MULTIPLIER, n), out=self.prefix[1:])
        self.undo = powers(INVERSE, n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed digests of the substrings [begin, end); equal bytes give equal digests wherever they stand."""
        return mix((self.prefix[end] - self.prefix[begin]) * self.undo[begin])


def local_path(path: str) -> str:
    """Model files may come with a file: scheme."""
    return path[7:] if path.startswith("file://") else path


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
