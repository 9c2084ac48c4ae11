"""Packing token pieces into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces come by
falling length; among the open sequences that a piece fits under every constraint, the one with the largest weighted dot product of
the piece's demand and the residual capacities, or with the smallest residual norm after the placement, takes it.

Pieces of one length are alike, and so are sequences with the same residuals. So the choice is made once for each length and each
kind of open sequence, with counts: its work depends on the capacities (lengths of 1 to `tokens`) and not on the number of
documents. The driver sees one count for each length only. Every piece then gets its place from its rank among the pieces of
its length.

Documents with more tokens than a sequence are cut into full pieces; the first piece takes the rest. Null text counts as
empty: such a document is its end id alone. Equal rows are packed as separate pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelgauge.llm.chunk_tokens import tokenizer
from modelgauge.llm.common import extended, slices

CHUNKS = 64


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. The defaults for documents and attention never bind before the tokens do."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"  # or "dot"


def pack_counts(counts: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank behind the last, first sequence, offset): rank r of a length goes to sequence first + r - first rank."""
    limit = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.float64)
    weights = np.array(cap.weights)
    open_: list[list] = []  # residual tokens, documents, attention; runs of sequences [begin, end)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], dtype=np.float64)
        if (need > limit).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = [b for b in open_ if b[0] >= length and b[1] >= 1 and b[2] >= length * length]
            if fits:
                residual = np.array([b[:3] for b in fits], dtype=np.float64)
                if cap.rule == "dot":
                    worth = ((residual / limit) * (need / limit) * weights).sum(axis=1)
                else:
                    worth = -((((residual - need) / limit) ** 2) * weights).sum(axis=1)
                bins = fits[int(worth.argmax())]
                open_.remove(bins)
            else:
                each = max(1, min(cap.tokens // length, cap.documents, cap.attention // (length * length)))
                bins = [cap.tokens, cap.documents, cap.attention, [(sequences, sequences + -(-left // each))]]
                sequences += -(-left // each)
            while left and bins[0] >= length and bins[1] >= 1 and bins[2] >= length * length:
                took, rest = [], []
                for begin, end in bins[3]:
                    n = min(left, end - begin)
                    if n:
                        out.append((length, rank, rank + n, begin, cap.tokens - bins[0]))
                        took.append((begin, begin + n))
                        rank, left = rank + n, left - n
                    if begin + n < end:
                        rest.append((begin + n, end))
                if rest:
                    _put(open_, [*bins[:3], rest])
                bins = [bins[0] - length, bins[1] - 1, bins[2] - length * length, took]
            _put(open_, bins)
    return out


def _put(open_: list[list], bins: list) -> None:
    """Sequences with equal residuals are one kind."""
    if not bins[0] or not bins[1] or not bins[2]:
        return
    for other in open_:
        if other[:3] == bins[:3]:
            other[3] += bins[3]
            return
    open_.append(bins)


def _pieces(path: str, end_id: int, size: int, keep: list[str], with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, stop = tokenizer(path), np.uint32(end_id).tobytes()
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, body in enumerate(tok.encode(batch.column("text").to_pylist())):
                    body += stop
                    n = len(body) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        part = body[4 * a : 4 * b]
                        row.append(k)
                        piece.append(j)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, dtype=np.uint32).astype(np.int32))
                kept = batch.select(keep).take(pa.array(row, pa.int64())).columns
                extra = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *extra],
                    [*keep, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
                )

    return run


def pieces(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Pieces of at most `size` ids of every whole text followed by `end_id`; `with_ids` adds ids array<int>."""
    more = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(*keep, "text").mapInArrow(_pieces(path, end_id, size, list(keep), with_ids), extended(docs.select(*keep), more))


def pack(parts: DataFrame, cap: Capacity = Capacity(), key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`parts` (a stored table with length) with sequence_id and offset.

    Ranks of a length are counted in chunks by the digest of the key, so one very common length spreads over all tasks.
    """
    spark = parts.sparkSession
    chunk = F.pmod(F.xxhash64(*key), F.lit(CHUNKS)).cast("int")
    table = [(r[0], r[1], r[2]) for r in parts.groupBy("length", chunk.alias("c")).count().collect()]  # at most `tokens` x CHUNKS counts
    counts: dict[int, int] = {}
    bases = []
    for length, c, n in sorted(table):
        bases.append((length, c, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    places: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for p in pack_counts(counts, cap):
        places.setdefault(p[0], []).append(p)
    rows = []
    size = {(length, c): n for length, c, n in table}
    for length, c, base in bases:  # cut the places at chunk borders: each chunk meets its own rows only
        n = size[length, c]
        for _, a, b, seq, off in places[length]:
            lo, hi = max(a, base), min(b, base + n)
            if lo < hi:
                rows.append((length, c, lo - base, hi - base, seq + lo - a, off))
    plan = spark.createDataFrame(rows, "length long, _c int, _a long, _b long, _s long, _o long")
    ranked = parts.withColumn("_c", chunk).withColumn("_r", F.row_number().over(Window.partitionBy("_c", "length").orderBy(*key, "ids_crc32")) - F.lit(1))
    met = ranked.join(plan, ["length", "_c"]).where("_r >= _a AND _r < _b")
    return met.withColumns({"sequence_id": F.expr("_s + _r - _a"), "offset": F.col("_o")}).select(*parts.columns, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids of every packed sequence, from pieces with ids."""
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
