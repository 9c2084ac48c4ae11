"""Token-id files: documents as blocks of range-coded ids, in ascending doc_id order.

A token file is a set of blocks; every block is coded from a fresh model, carries the CRC-32 of its ids and can be read alone. A block holds whole
documents up to BLOCK ids together; a longer document is cut into segments with a block each. The index of a block names its
documents: id, position in the file, ids before the segment, ids in it. Files follow each other in ascending doc_id order, rows without an
id first, ties by text.

Blocks are stored as rows of a Parquet data set written by Spark, one partition for a file, so that writing commits atomically wherever the data
lie and lost tasks are repeated. Reading decodes blocks in any order, checks each checksum and fails on a mismatch.

Null text counts as empty: such a document is its end id alone. Equal rows are separate documents.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from modelgauge.llm.chunk_tokens import tokenizer
from modelgauge.llm.common import fresh_path, slices, stored
from modelgauge.llm.range_coder import decode, encode

BLOCK = 2048
#: Blocks coded side by side (their models take some 100 MB), bytes of text split at a time, and documents in a file.
SIDE_BY_SIDE = 4096
TEXT_BYTES = 16 << 20
FILE_ROWS = 4000
MOST_FILES = 5000
BLOCKS = "file int, block int, n_ids int, crc32 long, payload binary, documents array<struct<doc_id:long,position:int,start:int,n:int>>"
_INDEX = pa.list_(pa.struct([("doc_id", pa.int64()), ("position", pa.int32()), ("start", pa.int32()), ("n", pa.int32())]))


def _coded(path: str, end_id: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, stop = tokenizer(path), np.array([end_id], np.uint32)
        file, number, position = TaskContext.get().partitionId(), 0, 0
        ready: list[tuple[np.ndarray, list[dict]]] = []
        body: list[np.ndarray] = []
        index: list[dict] = []
        size = 0

        def close() -> None:
            nonlocal body, index, size
            if index:
                ready.append((np.concatenate(body), index))
            body, index, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ready
            some, ready = ready[:SIDE_BY_SIDE], ready[SIDE_BY_SIDE:]
            ids = [i for i, _ in some]
            numbers = range(number, number + len(some))
            out = [[file] * len(some), list(numbers), [len(i) for i in ids], [zlib.crc32(i) for i in ids], encode(ids), [d for _, d in some]]
            number += len(some)
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), _INDEX)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["file", "block", "n_ids", "crc32", "payload", "documents"])

        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                every, offsets = tok.encode_column(batch.column("text"))
                ends = offsets.tolist()
                for doc_id, first, last in zip(batch.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True):
                    n = last - first + 1
                    if size + n > block:
                        close()
                    if n <= block:
                        body += [every[first:last], stop]
                        index.append({"doc_id": doc_id, "position": position, "start": 0, "n": n})
                        size += n
                    else:
                        ids = np.concatenate((every[first:last], stop))
                        for start in range(0, n, block):
                            body.append(ids[start : start + block])
                            index.append({"doc_id": doc_id, "position": position, "start": start, "n": len(body[-1])})
                            close()
                    position += 1
                    while len(ready) >= SIDE_BY_SIDE:
                        yield flush()
        close()
        while ready:
            yield flush()

    return run


def write(docs: DataFrame, path: str, model: str, end_id: int = 2, block: int = BLOCK) -> None:
    """Tokenise whole texts, end each with `end_id`, and write token files under `path`."""
    files = max(1, min(MOST_FILES, -(-docs.count() // FILE_ROWS)))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(files, F.asc_nulls_first("doc_id")).sortWithinPartitions(*order)
    dealt.mapInArrow(_coded(model, end_id, block), BLOCKS).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "doc_id", "position", "start", "ids"]
    for whole in batches:
        most = -(-whole.num_rows // (-(-whole.num_rows // SIDE_BY_SIDE) or 1)) or 1  # evenly
        for first in range(0, whole.num_rows, most):
            batch = whole.slice(first, most)
            sizes = batch.column("n_ids").to_pylist()
            found = decode(batch.column("payload").to_pylist(), sizes)
            out: tuple[list, ...] = ([], [], [], [], [])
            for file, number, crc, ids, index in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "crc32")), found, batch.column("documents").to_pylist(), strict=True):
                body = ids.astype("<u4").tobytes()
                if zlib.crc32(body) != crc:
                    raise ValueError(f"block {number} of file {file} is damaged")
                at = 0
                for d in index:
                    for column, x in zip(out, (file, d["doc_id"], d["position"], d["start"], body[4 * at : 4 * (at + d["n"])]), strict=True):
                        column.append(x)
                    at += d["n"]
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def read(spark_read, path: str) -> DataFrame:
    """file, doc_id, position, start and ids (little-endian unsigned 32-bit) of every document segment in the files under `path`."""
    return spark_read.schema(BLOCKS).parquet(path).mapInArrow(_read, "file int, doc_id long, position int, start int, ids binary")


def _times(matrix: Sequence[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return total


@functools.lru_cache(maxsize=4096)
def _zeros(size: int) -> tuple[int, ...]:
    """Matrix over GF(2) that carries a CRC-32 over `size` zero bytes."""
    shift = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        shift = [_times(shift, x) for x in shift]  # eight: a zero byte
    total = [1 << i for i in range(32)]
    while size:
        if size & 1:
            total = [_times(shift, x) for x in total]
        shift, size = [_times(shift, x) for x in shift], size >> 1
    return tuple(total)


def crc_joined(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings end to end from the CRCs of both and the size of the second."""
    return _times(_zeros(size), first) ^ second


def _whole_crc(parts: pd.Series) -> pd.Series:
    def one(segments: np.ndarray) -> int:
        crc = 0
        for i, s in enumerate(segments):
            crc = s["crc"] if not i else crc_joined(crc, s["crc"], 4 * s["n"])
        return crc

    return parts.map(one)


def documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in `read` rows."""
    n = (F.octet_length("ids") / 4).cast("long")
    narrow = stored(segments.select("file", "doc_id", "position", "start", n.alias("n"), F.crc32("ids").alias("crc")), "segments")
    parts = F.array_sort(F.collect_list(F.struct("start", "n", "crc"))).alias("parts")
    whole = narrow.groupBy("file", "position", "doc_id").agg(F.sum("n").alias("n_tokens"), parts)
    crc = F.when(F.size("parts") == 1, F.col("parts")[0]["crc"]).otherwise(pandas_udf(_whole_crc, "long")(F.when(F.size("parts") > 1, F.col("parts")).otherwise(F.array().cast("array<struct<start:int,n:bigint,crc:bigint>>"))))
    whole = whole.select("file", "position", "doc_id", "n_tokens", crc.alias("ids_crc32"))
    totals = narrow.groupBy("file").agg(F.sum("n").alias("ids_in_file"))
    every = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_FILES rows
    before = totals.select("file", F.coalesce(F.sum("ids_in_file").over(every), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = whole.join(F.broadcast(before), "file").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, model: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and describe the documents read back from them."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write(docs, path, model, end_id)
    described = read(spark.read, path).select("file", "doc_id", "position", "start", "ids")
    return documents(described)
