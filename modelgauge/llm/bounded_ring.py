"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Rows stand on a ring by the digest of their key, every shard at several places (virtual nodes). A row goes to the next shard
clockwise; if that is full, it continues to the next one that is not. Loads are bounded by row quotas that differ by one at most and
add up to the number of rows, so every shard ends exactly full (law `rows`), while most rows stay with the shard that the
ring names.

The ring is cut into a fixed number of equal slices and the virtual nodes stand on slice borders, so all rows of a slice prefer the
shards in the same order. Only the row count of each slice (a fixed number of values whatever the input) goes to the driver, which walks
the slices clockwise and says which ranks of a slice go where. A row's rank inside its slice is a window over that slice.

Null keys stand at one place of the ring like any other key; null text has size 1 and the checksum of the empty text. Rows
that agree in key and content are interchangeable: they get distinct slots of the same neighbourhood.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelgauge.llm.common import MASK63

SLICES = 1 << 14
VNODES = 64


def ring(shards: int, vnodes: int = VNODES, cuts: int = SLICES) -> list[tuple[int, int]]:
    """(slice at whose start it stands, shard) of every virtual node in ring order."""

    def place(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % cuts

    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def preferences(nodes: list[tuple[int, int]], at: int) -> list[int]:
    """Shards in the order in which a row of slice `at` meets them clockwise."""
    begin = bisect.bisect_right(nodes, (at, 1 << 30))
    return list(dict.fromkeys(s for _, s in nodes[begin:] + nodes[:begin]))


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: dict[int, int], shards: int, vnodes: int = VNODES, cuts: int = SLICES) -> list[tuple[int, int, int, int, int]]:
    """(slice, first rank, rank behind the last, shard, slot of the first) for every part of a slice, walking clockwise."""
    nodes = ring(shards, vnodes, cuts)
    total = quotas(sum(counts.values()), shards)
    free, out = list(total), []
    for at in sorted(counts):
        rank, left = 0, counts[at]
        for s in preferences(nodes, at):
            take = min(left, free[s])
            if take:
                out.append((at, rank, rank + take, s, total[s] - free[s]))
                free[s] -= take
                rank, left = rank + take, left - take
            if not left:
                break
    return out


def on_ring(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(MASK63))


def assign(rows: DataFrame, key: str, ties: list[str], shards: int = 16, vnodes: int = VNODES, cuts: int = SLICES) -> DataFrame:
    """`rows` with shard int and slot long (gapless from 0 in each shard). `ties` orders rows that share a key.

    Give narrow rows: those columns are shuffled once. The counting pass reads `key` alone.
    """
    place = on_ring(F.col(key))
    cut = F.shiftright(place, 63 - (cuts.bit_length() - 1)).cast("int")
    counts = {r[0]: r[1] for r in rows.groupBy(cut.alias("c")).count().collect()}  # at most `cuts` rows
    parts = rows.sparkSession.createDataFrame(plan(counts, shards, vnodes, cuts), "_cut int, _first long, _behind long, shard int, _slot long")
    ranked = rows.withColumns({"_c": cut, "_p": place})
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("_p", key, *ties)) - F.lit(1))
    # the plan has one row for a slice and one more for each time a shard fills up: cuts + shards rows at most
    met = ranked.join(F.broadcast(parts), (F.col("_c") == F.col("_cut")) & (F.col("_r") >= F.col("_first")) & (F.col("_r") < F.col("_behind")))
    return met.withColumn("slot", F.col("_slot") + F.col("_r") - F.col("_first")).drop("_c", "_p", "_r", "_cut", "_first", "_behind", "_slot")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(narrow, "doc_id", ["text_crc32", "size"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
