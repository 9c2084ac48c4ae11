"""Document fingerprints by context-triggered piecewise hashing.

A rolling digest over 7 bytes gives every byte position a level (the number of trailing zero bits). At block size 2**k the text is cut
behind each position of level k or more, and where that leaves more than 4 blocks without a cut (periodic texts), every 4 blocks. Every
chunk gives two base-64 characters of its digest: the signature. A fingerprint has the signatures at the smallest block size with
fewer than 64 triggered cuts and fewer than 64 spans of 4 blocks, and at the next one: "k:signature:signature". Fingerprints are
compared where they share a block size, by the edit distance of the chunk sequences (a chunk is one symbol): the likeness is one minus
the distance over the longer length, the larger value if both sizes match, and 0 if none does.

Fingerprints depend on the text alone. Null text counts as empty; empty texts have the fingerprint "0::" and are like each other
and nothing else.

`with_next` pairs every document with the next one in falling doc_id order (the last with the first) by windows over quantile buckets of
the id; each bucket also gets the first documents of the following one. Documents without an id come last, ties go by text. Only doc_id and
text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from modelgauge.llm.common import RollingDigest, mix, slices, table_of_bytes, text_bytes

SPAN = 7
CUTS = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BUCKET_ROWS = 5_000
MOST_BUCKETS = 5_000
_TABLE = table_of_bytes(3)
_PAIRS = np.array([a + b for a in ALPHABET for b in ALPHABET])


def _cuts(data: np.ndarray, offsets: np.ndarray, least: int) -> list[np.ndarray]:
    """Positions of level k or more for k = 0 (every byte), 1, 2, ... until no text has CUTS of them, and at least to `least` + 1."""
    padded = np.zeros(len(data) + SPAN - 1, np.uint64)
    padded[SPAN - 1 :] = _TABLE[data]
    roll = np.zeros(len(data), np.uint64)
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    for i in range(SPAN):
        part = padded[i : i + len(data)].copy()
        if i < SPAN - 1:  # bytes of the text before do not count
            lack = SPAN - 1 - i
            for j in range(lack):
                at = offsets[:-1] + j
                part[at[at < offsets[1:]]] = 0
        roll = roll * multiplier + part
    roll = mix(roll)
    at, out = np.arange(len(data)), []
    while True:
        out.append(at)
        if len(out) > max(1, least) and (not len(at) or np.diff(np.searchsorted(at, offsets)).max() < CUTS):
            break
        at = at[(roll[at] >> np.uint64(len(out) - 1)) & np.uint64(1) == 0]
    at = at[(roll[at] >> np.uint64(len(out) - 1)) & np.uint64(1) == 0]
    return [*out, at]


def _with_forced(edges: np.ndarray, most: int) -> np.ndarray:
    gaps = np.diff(edges)
    wide = np.flatnonzero(gaps > most)
    if not len(wide):
        return edges
    more = [np.arange(edges[i] + most, edges[i + 1], most) for i in wide]
    return np.sort(np.concatenate([edges, *more]))


def fingerprints(texts: pa.Array) -> list[str]:
    data, offsets = text_bytes(texts)
    if not len(data):
        return ["0::"] * len(texts)
    spans_of_four = np.maximum(np.diff(offsets) // (4 * CUTS), 0)
    need = np.where(spans_of_four > 0, np.floor(np.log2(np.maximum(spans_of_four, 1))).astype(np.int64) + 1, 0)
    levels = _cuts(data, offsets, int(need.max()))
    spans = [np.searchsorted(at, offsets) for at in levels]
    digest = RollingDigest(data, _TABLE)
    sized = np.stack([np.diff(s) for s in spans[:-1]])
    block = np.maximum((sized < CUTS).argmax(axis=0), need)
    begins: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    for i, k in enumerate(block.tolist()):
        a, b = int(offsets[i]), int(offsets[i + 1])
        for level in (k, k + 1):
            cut = levels[level][spans[level][i] : spans[level][i + 1]] + 1
            edges = _with_forced(np.unique(np.concatenate(([a], cut, [b]))), 4 << level)
            begins.append(edges[:-1])
            ends.append(edges[1:])
    symbols = _PAIRS[(digest.of(np.concatenate(begins), np.concatenate(ends)) >> np.uint64(52)).astype(np.int64)].tolist()
    out, at = [], 0
    for i, k in enumerate(block.tolist()):
        n, m = len(begins[2 * i]), len(begins[2 * i + 1])
        out.append(f"{k}:{''.join(symbols[at : at + n])}:{''.join(symbols[at + n : at + n + m])}" if n else "0::")
        at += n + m
    return out


def distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two symbol sequences, bit-parallel over the first."""
    if not a or not b:
        return len(a) or len(b)
    place: dict[str, int] = {}
    for i, s in enumerate(a):
        place[s] = place.get(s, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for s in b:
        eq = place.get(s, 0)
        x = eq | down
        eq |= ((eq & up) + up) ^ up
        plus, minus = down | ~(eq | up) & full, up & eq
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~(x | plus) & full, plus & x
    return score


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (ka, *sa), (kb, *sb) = a.split(":"), b.split(":")
    own = {int(ka): sa[0], int(ka) + 1: sa[1]}
    other = {int(kb): sb[0], int(kb) + 1: sb[1]}
    best = 0.0
    for k in own.keys() & other.keys():
        x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (own[k], other[k]))
        if x and y:
            best = max(best, 1 - distance(x, y) / max(len(x), len(y)))
    return best


def _order() -> list[Column]:
    return [F.desc_nulls_last("doc_id"), F.asc_nulls_first("text")]


def _bucket(cuts: list[int]) -> Callable[[str], Column]:
    """Number of an id's bucket in reading order: 0 has the largest ids, the last one the rows without an id."""
    table = np.array(cuts, dtype=np.float64)

    def number(ids: pd.Series) -> pd.Series:
        known = len(table) - np.searchsorted(table, ids.to_numpy(dtype=np.float64, na_value=np.nan), side="left")
        return pd.Series(np.where(ids.isna(), len(table) + 1, known).astype(np.int32))

    return pandas_udf(number, "int")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text of every row of `docs` in falling doc_id order, the first following the last."""
    n = docs.count()
    count = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.1 / count)}) if count > 1 else []
    rows = docs.select("doc_id", "text").withColumn("bucket", _bucket(cuts)("doc_id"))
    heads = {r["bucket"]: r["head"] for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}  # at most MOST_BUCKETS + 2
    used = sorted(heads)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # the first bucket follows the last
    pairs = docs.sparkSession.createDataFrame([(b, heads[b], before[b]) for b in used], "bucket int, head long, before int")
    lead = rows.join(F.broadcast(pairs), "bucket").where(F.col("doc_id").eqNullSafe(F.col("head")))  # one row a bucket, more on ties
    ghosts = lead.select("doc_id", "text", F.col("before").alias("bucket"), F.lit(1).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(0)).union(ghosts)
    window = Window.partitionBy("bucket").orderBy("ghost", *_order())
    return both.withColumn("next_text", F.lead("text").over(window)).where("ghost = 0").select("doc_id", "text", "next_text")


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to as many of the next document's first (or all of them)."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            texts, following = ([t or "" for t in batch.column(c).to_pylist()] for c in ("text", "next_text"))
            changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
            own, new = fingerprints(pa.array(texts, pa.string())), fingerprints(pa.array(changed, pa.string()))
            reused = [i + 1 < len(texts) and following[i] == texts[i + 1] for i in range(len(texts))]
            left = iter(fingerprints(pa.array([f for f, r in zip(following, reused, strict=True) if not r], pa.string())))
            after = [own[i + 1] if r else next(left) for i, r in enumerate(reused)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(changed, pa.string()), pa.array(own, pa.string()), pa.array(new, pa.string()),
                    pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document."""
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(_compared, schema)
