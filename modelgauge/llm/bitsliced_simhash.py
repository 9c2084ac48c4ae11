"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, compared bit-sliced.

A fingerprint's bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42; repeats count). Texts without a word,
empty and null texts have the fingerprint zero and are linked like any other. Documents whose fingerprints differ in at most
`radius` bits are linked; a component carries its smallest doc_id (null only if none of its rows has an id). Equal rows are rows of
their own. Only doc_id and text are read, so further columns may have any name. An empty table gives no rows.

How pairs meet: the 64 bits are cut into radius + 2 chunks; two fingerprints within the radius agree on two chunks at least, so each
distinct fingerprint stands once under every pair of chunks. Groups over GROUP fingerprints are split by the same argument over the
bits still undecided (radius + 1 parts, one of which must agree), twice at most: what is left undecided is then 15 bits, so no group
can exceed 2**15 distinct fingerprints, whatever the data. No pair is lost and no list of all pairs is made: a task returns a
spanning forest of the links that it finds.

How they are compared: bit planes are stored vertically, 64 fingerprints a word. A plane against itself shifted by s lanes gives the
differing bits of all pairs (i, i + s) at once; a carry-save adder takes two such planes a step into bitwise counters that start
so that the carry out of the last one means "over the radius". Words in which no lane can still be within it are abandoned.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm.common import slices, stored
from modelgauge.llm.hamming_minhash import components

SEED = 42
SHINGLE = 3
RADIUS = 2
GROUP = 2048
REFINEMENTS = 2
PIECE = 4 << 20
BATCH = 1 << 16

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some megabytes of text at a time."""
    begin = 0
    while begin < len(data):
        cut = _SPACE.search(data, begin + PIECE)
        end = cut.start() if cut else len(data)
        yield data[begin:end].split()  # splits at 20 and 09 to 0D
        begin = end


def simhash(text: str | None) -> int:
    """Fingerprint of one whole text."""
    counts, n, carried = np.zeros(64, np.int64), 0, []
    for words in _words((text or "").encode().lower()):  # bytes: A to Z only
        words = carried + words
        carried = words[1 - SHINGLE :]
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            found = np.array([simhash(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all values, 64 values a word, with spare words at the end."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    words = -(-len(values) // 64)
    out = np.zeros((64, 2 * words + 2), np.uint64)
    out.view(np.uint8)[:, : -(-len(values) // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return out


def _lanes(flags: np.ndarray) -> np.ndarray:
    packed = np.zeros(-(-len(flags) // 64) * 8, np.uint8)
    packed[: -(-len(flags) // 8)] = np.packbits(flags, bitorder="little")
    return packed.view(np.uint64)


def close_pairs(values: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the same group (equal neighbours in `group`) whose values differ in at most `radius` bits."""
    none = np.zeros(0, np.int64)
    if len(values) < 2:
        return none, none
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(edge)
    left = np.repeat(edge[1:], sizes) - np.arange(len(values))  # rows from here to the group's end
    plane = planes(values)
    order = np.arange(64).reshape(4, 16).T.ravel()  # what two chunks fix is spread over the order
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    first, second = [], []
    for shift in range(1, int(sizes.max())):
        mask = _lanes(left > shift)
        at = np.flatnonzero(mask)
        mask = mask[at]
        q, r = np.uint64(shift >> 6), np.uint64(shift & 63)
        far = at + int(q)
        count = [np.full(len(at), ~np.uint64(0) if start >> i & 1 else np.uint64(0)) for i in range(width)]
        over = np.zeros(len(at), np.uint64)
        for step in range(0, 64, 2):
            d = []
            for b in order[step : step + 2]:
                p = plane[b]
                other = p[far] >> r
                if r:
                    other |= p[far + 1] << (np.uint64(64) - r)
                d.append(p[at] ^ other)
            odd = d[0] ^ d[1]
            if width:
                carry = (d[0] & d[1]) | (count[0] & odd)
                count[0] = count[0] ^ odd
                for i in range(1, width):
                    carry, count[i] = carry & count[i], carry ^ count[i]
                over |= carry
            else:
                over |= d[0] | d[1]
            if step % 8 == 6:
                alive = (mask & ~over) != 0
                if not alive.all():
                    at, far, mask, over, count = at[alive], far[alive], mask[alive], over[alive], [c[alive] for c in count]
                    if not len(at):
                        break
        if len(at):
            hit = np.unpackbits((mask & ~over).view(np.uint8), bitorder="little").reshape(-1, 64)
            word, lane = np.nonzero(hit)
            first.append(at[word] * 64 + lane)
            second.append(at[word] * 64 + lane + shift)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs (a, b) from each of n indexes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def masks(radius: int = RADIUS) -> list[list[tuple[int, ...]]]:
    """Bits fixed by each table: at level 0 two of radius + 2 chunks, below each table of the level above and one part of its other bits."""
    cut = [tuple(c.tolist()) for c in np.array_split(np.arange(64), radius + 2)]
    levels = [[a + b for a, b in itertools.combinations(cut, 2)]]
    for _ in range(REFINEMENTS):
        below = []
        for fixed in levels[-1]:
            free = np.setdiff1d(np.arange(64), fixed)
            below += [fixed + tuple(part.tolist()) for part in np.array_split(free, radius + 1)]
        levels.append(below)
    return levels


def _signed(bits: tuple[int, ...]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _linked(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forest edges (a, b) among rows (t, k, fp) sorted by (t, k); whole groups are taken together, many groups at a time."""

    def compared(t: np.ndarray, k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[False, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        label = forest(len(fp), *close_pairs(fp.view(np.uint64), group, radius))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "k", "fp")))
            if sum(len(x[0]) for x in held) < BATCH:
                continue
            t, k, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.flatnonzero((t != t[-1]) | (k != k[-1])).max(initial=-1)) + 1  # the last group may go on
            if last:
                yield compared(t[:last], k[:last], fp[:last])
            held = [(t[last:], k[last:], fp[last:])]
        if held:
            t, k, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(t):
                yield compared(t, k, fp)

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints `fp` connected by differences of at most `radius` bits."""
    levels, found = masks(radius), None
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(levels[0])))
    rows = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    for level in range(len(levels)):
        several = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
        met = stored(rows.join(several, ["t", "k"]).select("t", "k", "fp", "n"), "simhash-keys")
        last = level + 1 == len(levels)
        small = met if last else met.where(F.col("n") <= GROUP)
        own = small.select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_linked(radius), "a long, b long")
        found = own if found is None else found.union(own)
        if last or met.where(F.col("n") > GROUP).isEmpty():
            return stored(found.distinct(), "simhash-links")
        parts = radius + 1
        below = [F.lit(_signed(m)) for m in levels[level + 1]]
        child = F.explode(F.sequence(F.col("t") * parts, F.col("t") * parts + parts - 1)).alias("t")
        rows = met.where(F.col("n") > GROUP).select("fp", child)
        rows = rows.select("t", F.col("fp").bitwiseAND(F.element_at(F.array(*below), F.col("t") + 1)).alias("k"), "fp")


def near_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row of `docs` (doc_id, text)."""
    rows = stored(fingerprints(docs), "simhash")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    comp = components(links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "comp")
    placed = classes.join(comp, "fp", "left").select("fp", "first_id", F.coalesce("comp", "fp").alias("comp"))
    smallest = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = placed.join(smallest, "comp").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
