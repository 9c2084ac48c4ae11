"""Removal of repeated windows by depth-limited radix passes over suffixes of bytes or words.

A suffix matters only through its first `window` tokens (400 bytes), so windows of that length are ordered by most-significant-digit
passes and a group that is still together after the last pass is a repeated window. Singletons leave after each pass. Digits are wide,
and a window's leading digit is the half-window gram in it with the smallest digest (its anchor), so the first pass handles one row for
each anchor instead of one for each token: equal windows have the same anchor at the same offset, about two anchors stand in a window.

0. Inside each text: anchors with equal surroundings, and windows over anchors with one gram that the text itself repeats, are settled at once.
1. First digit: digest of the anchor gram. Anchors whose gram occurs once leave.
2. All other tokens around the anchor (up to half a window before, up to a window from it) in one digit: equal surroundings make every window over the
   anchor repeated, and one of them stands for all in the last pass.
3. Last digit of the windows over each remaining anchor, within the groups of the first digit: windows at the same offset with equal
   digests are repeated. Very large groups do this as an aggregation over window rows instead of inside one task.

Digests have 64 bits. Matches never cross documents; repeats inside one document and between equal documents count. Null text
counts as empty, texts under a window stay as they are. Rows with the same doc_id and different texts are told apart by a digest of
the text, equal rows count as repeats of each other. Words are what stands between white space (`[^\x20\x09-\x0D]+`), compared by
their bytes; white space between them does not count. Further columns of the input may have any name; those in `keep` come through.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm.common import RollingDigest, extended, mix, slices, stored, table_of_bytes, text_bytes

WINDOW = 400
BYTES, WORDS = "bytes", "words"
#: Bytes of texts that are held as digests at a time; words take some ten times their bytes while they are digested.
SLICE = {BYTES: 2 << 20, WORDS: 1 << 18}
#: Groups of more distinct surroundings than this compare windows by an aggregation over all tasks; a smaller one is held in a task (about 1.5 KB
#: for each, as windows are compared for OFFSETS offsets at a time).
TASK_GROUP = 100_000
OFFSETS = 20
_TABLE = table_of_bytes(9)
_SPANS = "array<struct<begin:long,end:long>>"


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of the texts that stand end to end in `data`."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    inside = np.concatenate((word, [False]))
    before = np.concatenate(([False], word))
    return np.flatnonzero(inside & (~before | cut)), np.flatnonzero(before & (~inside | cut))


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for every word of the texts, and the n + 1 offsets of the texts in them."""
    begin, end = word_edges(data, offsets)
    return RollingDigest(data, _TABLE).of(begin, end) if len(begin) else np.zeros(0, np.uint64), np.searchsorted(begin, offsets)


def _sliding(values: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """`best` (minimum or maximum) of every run of `width` values."""
    n = len(values)
    full = np.full(-(-n // width) * width, fill, dtype=np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(digest: RollingDigest, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram digests of a text's anchors: grams that are the smallest of some window (all of them on a tie)."""
    gram = window // 2
    width = window - gram + 1
    begin = np.arange(n - gram + 1)
    grams = digest.of(begin, begin + gram)
    least = _sliding(grams, width, np.minimum, (1 << 64) - 1)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(grams == _sliding(np.concatenate((pad, least, pad)), width, np.maximum, 0))
    return at, grams[at]


def _anchor_rows(window: int, unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each kind of anchor of a text, and one (k NULL) with the runs that the text's own repeats remove."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE[unit]):
                data, offsets = text_bytes(batch.column("text"))
                if unit == WORDS:
                    data, offsets = word_values(data, offsets)
                row: list[np.ndarray] = []
                columns: list[list] = [[] for _ in types]
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    if b - a < window:
                        continue
                    *found, spans = own_kinds(RollingDigest(data[a:b], _TABLE if unit == BYTES else None), b - a, window)
                    m = len(found[0]) + bool(spans)
                    row.append(np.full(m, i))
                    for column, x in zip(columns, (found[0].view(np.int64), found[1].view(np.int64), found[2], found[3], np.full(len(found[0]), b - a), found[4]), strict=False):
                        column += x.tolist() + [None] * bool(spans)
                    columns[-1] += [None] * len(found[0]) + ([[{"begin": x, "end": y} for x, y in spans]] if spans else [])
                if row:
                    kept = batch.select(["_id", "_h"]).take(pa.array(np.concatenate(row), pa.int64())).columns
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["_id", "_h", "f", "k", "pos", "n", "size", "own", "spans"])

    return run


def own_kinds(digest: RollingDigest, size: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Kinds of anchors (equal surroundings) of one text: digest f, gram k, a position, count (2 at most), whether the text itself repeats all
    windows over it; and the runs that those repeats cover. Periodic texts have many anchors and few kinds: a kind whose windows all
    occur over other kinds of the text too leaves at once.
    """
    gram = window // 2
    pos, grams = anchors(digest, size, window)
    left, right = np.minimum(pos, window - gram), np.minimum(size - pos, window)
    f = mix(digest.of(pos - left, pos + right) ^ (left * 4096 + right).astype(np.uint64))
    f, first, kind, count = np.unique(f, return_index=True, return_inverse=True, return_counts=True)
    at, k = pos[first], grams[first]
    own = count > 1
    many = own[kind]
    lo, hi = np.maximum(0, pos[many] + window - size), np.minimum(window - gram, pos[many])
    spans = list(zip((pos[many] - hi).tolist(), (pos[many] - lo + window).tolist(), strict=True))
    keep = np.ones(len(f), dtype=bool)
    _, group, together = np.unique(k, return_inverse=True, return_counts=True)
    for g in np.flatnonzero(together > 1):
        some = np.flatnonzero(group == g)
        back = np.arange(window - gram + 1)
        begin = at[some][:, None] - back
        there = (begin >= 0) & (begin + window <= size)
        order = np.argsort(-there.sum(axis=1), kind="stable")  # kinds with most windows stand for the others
        some, begin, there = some[order], begin[order], there[order]
        digests = digest.of(np.where(there, begin, 0), np.where(there, begin + window, 0))
        flags, new = _shared(digests, there)
        keep[some] = new.any(axis=1)
        own[some] |= (flags | ~there).all(axis=1)
        starts = np.unique(begin[flags])
        if len(starts):
            cut = np.flatnonzero(np.diff(starts) > 1)
            spans += list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + window).tolist(), strict=True))
    return f[keep], k[keep], at[keep], np.minimum(count[keep], 2), own[keep], merged(spans)


def _surroundings(window: int, unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    gram = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                rows: dict[str, list] = {"k": [], "f": [], "n": [], "m": [], "left": [], "bytes": []}
                for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                    body = text.encode()
                    if unit == WORDS:
                        body = np.frombuffer(body, np.uint8)
                        body = word_values(body, np.array([0, len(body)]))[0]
                    for w in wanted:
                        left = min(w["pos"], window - gram)
                        for name in ("k", "f", "n", "m"):
                            rows[name].append(w[name])
                        rows["left"].append(left)
                        some = body[w["pos"] - left : w["pos"] + window]
                        rows["bytes"].append(some if unit == BYTES else some.tobytes())
                types = {"left": pa.int32(), "bytes": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in rows.items()], list(rows))

    return run


def _window_digests(bodies: list[bytes], left: np.ndarray, window: int, offsets: int, unit: str = BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Digest of the window that begins d bytes before the anchor, for every surrounding (row) and d (column), and which exist; so many
    offsets d at a time."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8 if unit == BYTES else np.uint64)
    digest = RollingDigest(data, _TABLE if unit == BYTES else None)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64) // data.itemsize
    base = np.cumsum(sizes) - sizes
    last = window - window // 2 + 1
    for first in range(0, last, offsets):
        back = np.arange(first, min(last, first + offsets))
        there = (back <= left[:, None]) & (left[:, None] - back + window <= sizes[:, None])
        begin = np.where(there, left[:, None] - back + base[:, None], 0)
        yield digest.of(begin, np.minimum(begin + window, len(data))), there


def _shared(digests: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries that exist: which have an equal in their column, and which are the first of their kind in it."""
    alone = mix(np.arange(digests.size, dtype=np.uint64).reshape(digests.shape))
    digests = np.where(there, digests, alone)
    order = np.argsort(digests, axis=0, kind="stable")
    ranked = np.take_along_axis(digests, order, axis=0)
    same = ranked[1:] == ranked[:-1]
    flags, first = np.zeros(digests.shape, dtype=bool), np.ones(digests.shape, dtype=bool)
    flags[1:] |= same
    flags[:-1] |= same
    first[1:] = ~same
    out = np.empty_like(flags), np.empty_like(flags)
    for to, x in zip(out, (flags, first), strict=True):
        np.put_along_axis(to, order, x, axis=0)
    return out[0] & there, out[1] & there


def repeated(bodies: list[bytes], left: np.ndarray, window: int, unit: str = BYTES) -> np.ndarray:
    """Which windows over the anchors of one group occur at the same offset in another surrounding."""
    return np.hstack([_shared(*part)[0] for part in _window_digests(bodies, left, window, OFFSETS if len(bodies) > 1000 else window, unit)])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _last_digit(window: int, unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by k: compares the windows of one group after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("k", "f", "n", "left", "bytes")), strict=True))
        out: list[tuple[int, int, int]] = []
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            seen = {r[1]: r for r in group}  # equal rows bring a surrounding twice
            part = list(seen.values())
            if len(part) > 1:
                flags = repeated([r[4] for r in part], np.array([r[3] for r in part]), window, unit)
                out += [(r[1], a, b) for r, own in zip(part, flags, strict=True) if r[2] == 1 for a, b in runs(own)]
            if len(out) > 10_000:
                yield _range_batch(out)
                out = []
        yield _range_batch(out)

    return run


def _range_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["f", "lo", "hi"])


def _window_rows(window: int, unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                b = whole.slice(begin, 1000)
                (digests, there), = _window_digests(b.column("bytes").to_pylist(), np.asarray(b.column("left")).astype(np.int64), window, window, unit)
                row, back = np.nonzero(there)
                w = mix(digests[row, back] ^ back.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w), b.column("f").take(pa.array(row)), b.column("n").take(pa.array(row)), pa.array(back, pa.int32())], ["w", "f", "n", "lo"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _byte_spans(body: bytes, spans: list[tuple[int, int]], unit: str) -> list[tuple[int, int]]:
    """Token spans as byte spans; the white space after the last word of a span goes with it."""
    if unit == BYTES or not spans:
        return spans
    data = np.frombuffer(body, np.uint8)
    begin, _ = word_edges(data, np.array([0, len(data)]))
    edge = np.append(begin, len(data))
    return [(int(edge[a]), int(edge[b])) for a, b in spans]


def _cut_out(window: int, keep: list[str], as_text: bool, unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                sizes, spans, kept = [], [], []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                    body = (text or "").encode()
                    cuts = _byte_spans(body, merged([(x["begin"], x["end"]) for x in found or ()]), unit)
                    sizes.append(len(body))
                    spans.append([{"begin": a, "end": b} for a, b in cuts])
                    edges = [0, *(x for s in cuts for x in s), len(body)]
                    kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cuts else body)
                last = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                struct = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(spans, struct), last], [*keep, "n_bytes", "spans", "kept_text" if as_text else "kept_bytes"]
                )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), as_text: bool = False, unit: str = BYTES) -> DataFrame:
    """`keep` columns, n_bytes, spans array<struct<begin, end>> (removed runs of bytes) and kept_bytes of every row of `docs` (doc_id, text).

    Every copy of a repeated window goes, the first one too. `window` counts tokens of the `unit`.

    `as_text` gives kept_text instead: bytes of a character that a cut has split are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(*keep, text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_id"), F.xxhash64(text).alias("_h"))
    long_ = keyed.select("_id", "_h", "text").where(F.octet_length("text") >= (window if unit == BYTES else 2 * window - 1))
    rows = stored(long_.mapInArrow(_anchor_rows(window, unit), f"_id long, _h long, f long, k long, pos int, n int, size int, own boolean, spans {_SPANS}"), "anchors")

    met = rows.groupBy("k").agg(F.sum("n").alias("n")).where("n > 1 AND k IS NOT NULL").select("k")
    met = stored(rows.drop("spans").join(met, "k"), "met")
    kinds = met.groupBy("f").agg(F.max("k").alias("k"), F.sum("n").alias("n"), F.min(F.struct("_id", "_h", "pos")).alias("one"))
    kinds = stored(kinds.select("f", "k", "n", "one.*"), "kinds")
    open_ = kinds.groupBy("k").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("k", "m")
    wanted = kinds.join(open_, "k").groupBy("_id", "_h").agg(F.collect_list(F.struct("k", "f", "n", "m", "pos")).alias("wanted"))
    around = keyed.select("_id", "_h", "text").join(wanted, ["_id", "_h"]).select("text", "wanted")
    around = stored(around.mapInArrow(_surroundings(window, unit), "k long, f long, n long, m long, left int, bytes binary"), "around")

    small = around.where(F.col("m") <= TASK_GROUP).repartition(F.col("k")).sortWithinPartitions("k")
    some = small.mapInArrow(_last_digit(window, unit), "f long, lo int, hi int")
    large = around.where(F.col("m") > TASK_GROUP).dropDuplicates(["f"]).mapInArrow(_window_rows(window, unit), "w long, f long, n long, lo int")
    twice = large.groupBy("w").count().where("count > 1").select("w")
    more = large.where("n = 1").join(twice, "w").groupBy("f").agg(F.array_sort(F.collect_set("lo")).alias("d"))
    more = more.selectExpr("f", "filter(d, (x, i) -> i = 0 or get(d, i - 1) < x - 1) as lo", "filter(d, (x, i) -> i = size(d) - 1 or get(d, i + 1) > x + 1) as hi")
    more = more.select("f", F.inline(F.arrays_zip("lo", "hi")))
    full = kinds.where("n > 1").select("f", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    ranges = stored(full.union(some).union(more), "ranges")

    half = window - window // 2
    lo, hi = f"if(lo < 0, greatest(0, pos + {window} - size), lo)", f"if(lo < 0, least({half}, pos), hi)"
    placed = met.where("NOT own").join(ranges, "f").selectExpr("_id", "_h", f"struct(cast(pos - {hi} as bigint) as begin, cast(pos - {lo} + {window} as bigint) as end) as span")
    placed = placed.groupBy("_id", "_h").agg(F.collect_set("span").alias("spans"))
    local = rows.where("k IS NULL").select("_id", "_h", "spans")
    found = placed.union(local).groupBy("_id", "_h").agg(F.flatten(F.collect_list("spans")).alias("found"))
    joined = keyed.join(found, ["_id", "_h"], "left").select(*keep, "text", "found")
    last = "kept_text string" if as_text else "kept_bytes binary"
    return joined.mapInArrow(_cut_out(window, list(keep), as_text, unit), extended(docs.select(*keep), f"n_bytes long, spans array<struct<begin:long,end:long>>, {last}"))


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs (spans) of `remove_repeats` rows."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept_bytes")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"), "spans",
    )
