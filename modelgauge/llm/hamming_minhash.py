"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A document's set holds the digests of its distinct 5-word shingles. Its signature has 64 symbols of 16 bits, symbol k being taken from the
smallest digest under the k-th hash; two sets of similarity J differ in each symbol with probability 1 - J. Signatures that differ
in at most 31 symbols, cut into 16 chunks of 4, differ in at most one symbol in some chunk. So every chunk is indexed once for each
symbol left out: all pairs within the signature distance meet under a key. (For J = 0.75 a distance above 31 has probability 1e-5.)

Documents under a key are not paired with each other. Each is compared with the key's hub; links make components, and only then
members of one key that lie in different components are compared, all of them, because a link inside a component changes nothing.
Links are confirmed on full sets: 100 * intersection >= 75 * union.

Equal texts are one node from the start. Null text, empty text and text without words have an empty set and are linked with nothing.
A text of fewer than five words is one shingle. A null doc_id takes part but is no candidate for the component's smallest id; repeated
doc_ids with different texts are different nodes. Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm.common import RollingDigest, mix, slices, stored, table_of_bytes, text_bytes

WORDS = 5
SYMBOLS, CHUNK, CHUNKS = 64, 4, 16
#: Members, and bytes of their sets, in a block of a large group.
FAMILY_BLOCK = 4096
BLOCK_BYTES = 8 << 20
_TABLE = table_of_bytes(4)
_RNG = np.random.default_rng(4)
_MULTIPLY = _RNG.integers(1 << 62, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_PLACE = _RNG.integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def word_digests(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all documents end to end (A-Z lower-cased on request), and the n + 1 word offsets of the documents."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    fresh = word & edge[:-1]
    fresh[0] = word[0]
    fresh[1:] |= word[1:] & ~word[:-1]
    last = word & edge[1:]
    last[:-1] |= word[:-1] & ~word[1:]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return RollingDigest(data, _TABLE).of(starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle digests of every text."""
    words, at = word_digests(*text_bytes(texts))
    if len(words) >= WORDS:
        rolled = words[: len(words) - WORDS + 1] * _PLACE[0]
        for i in range(1, WORDS):
            rolled = rolled + words[i : len(words) - WORDS + 1 + i] * _PLACE[i]
        rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols for every set; all zero for an empty set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((len(sets), SYMBOLS), dtype=np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begin = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((flat ^ _FLIP[k]) * _MULTIPLY[k], begin)
            out[full, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingle_sets(batch.column("text"))
            rows = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                ["doc_id", "text_key", "n_shingles", "signature"],
            )


def chunk_keys(rows: np.ndarray) -> np.ndarray:
    """For every signature, a key for each chunk and each symbol of it left out."""
    parts = rows.reshape(len(rows), CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((len(rows), CHUNKS, CHUNK), dtype=np.uint64)
    chunk = np.arange(CHUNKS, dtype=np.uint64)
    for skip in range(CHUNK):
        key = np.broadcast_to(chunk * np.uint64(CHUNK) + np.uint64(skip), (len(rows), CHUNKS)).copy()
        for i in range(CHUNK):
            if i != skip:
                key = (key << np.uint64(16)) | parts[:, :, i]
        out[:, :, skip] = key  # 6 + 48 bits: nothing is lost
    return out.reshape(len(rows), -1).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin in range(0, whole.num_rows, 2000):
            batch = whole.slice(begin, 2000)
            rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
            keys = chunk_keys(rows)
            nodes = np.repeat(np.asarray(batch.column("node")), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])


def _confirmed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_a", 1 << 20):
                col = batch.column("text_b")
                own, hub = shingle_sets(batch.column("text_a")), {}
                b = batch.column("b").to_pylist()
                first: dict[int, int] = {}
                for i, node in enumerate(b):
                    first.setdefault(node, i)
                hub = dict(zip(first, shingle_sets(col.take(pa.array(list(first.values()), pa.int64()))), strict=True))
                keep = []
                for s, node in zip(own, b, strict=True):
                    t = hub[node]
                    both = np.concatenate((s, t))
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    keep.append(same > 0 and 100 * same >= percent * (len(s) + len(t) - same))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node of the links (a, b), by alternating large-star and small-star steps."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return named.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _text_key() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def near_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text)."""
    keyed = docs.select("doc_id", "text", _text_key().alias("text_key"))
    rows = stored(keyed.mapInArrow(_signed, "doc_id long, text_key binary, n_shingles long, signature binary"), "signed")
    nodes = rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the ids are fixed by writing them

    keys = nodes.where("n_shingles > 0").select("node", "signature").mapInArrow(_keys, "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = stored(keys.join(shared, "key"), "met")
    wanted = nodes.join(met.select("node").distinct(), "node").select("node", "text_key", F.col("first_id").alias("doc_id"))
    texts = keyed.join(wanted, (keyed.text_key == wanted.text_key) & keyed.doc_id.eqNullSafe(wanted.doc_id)).select("node", "text")
    texts = stored(texts, "texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(percent), "a long, b long")

    links = stored(confirm(_star_pairs(met)), "links")
    placed = met.join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    digest = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"d{i}") for i in range(2)]
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), *digest).where("x <> y")
    mixed = mixed.groupBy("m", "d0", "d1").agg(F.min("key").alias("key"))  # keys with the same members give the same pairs
    open_ = stored(placed.join(mixed.select("key"), "key").select("key", "node", "comp"), "open")
    links = links.union(confirm(_cross_pairs(open_, nodes, texts, percent)))
    comp = components(links)
    owned = nodes.select("node", "text_key", "first_id", "n_shingles").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = owned.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    owned = owned.join(smallest, "comp").select("text_key", F.col("component_id").alias("_c"))
    out = rows.select("doc_id", "text_key", "n_shingles").join(owned, "text_key")
    chosen = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("_c"))
    return out.select("doc_id", "n_shingles", chosen.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _star_pairs(met: DataFrame) -> DataFrame:
    """Every member of a key with the key's hub. Keys of one large group choose different hubs, so a member meets many of them."""
    hub = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("x"), "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    pairs = met.join(hub, "key").where("node <> hub")
    return stored(pairs.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct(), "pairs")


def _cross_pairs(open_: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may be similar, from members (key, node, comp) of keys that hold several components.

    The members of a key are a family; a family's overlaps are counted from its postings inside tasks, and only pairs that reach the
    similarity leave them. Large families are cut into blocks by count and bytes, each pair of blocks being one group.
    """
    family = open_.join(nodes.select("node", "n_shingles"), "node").withColumnRenamed("key", "family")
    several = family.groupBy("family").agg(F.count("*").alias("m"), F.sum(F.col("n_shingles") * 4).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("m") / F.lit(FAMILY_BLOCK), F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    family = family.join(several.select("family", blocks.alias("blocks")), "family").withColumn("own", own)
    family = family.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.concat_ws("/", "family", F.least("own", "other"), F.greatest("own", "other"))
    family = family.select("node", "comp", group.alias("grp"))
    sets = texts.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(_short_sets, "node long, tokens binary")
    held = family.join(sets, "node").repartition(F.col("grp")).sortWithinPartitions("grp")
    return held.mapInArrow(_family_pairs(percent), "a long, b long").distinct()


def _short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "tokens"])


def _family_pairs(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("grp", "node", "comp", "tokens")), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            _, node, comp, tokens = zip(*group, strict=True)
            a, b = similar(np.array(node), np.array(comp), [np.frombuffer(t, np.uint32) for t in tokens], percent - 1)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return run


def similar(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components with at least `percent` similarity; the largest component is not compared with itself."""
    names, member, count = np.unique(comp, return_inverse=True, return_counts=True)
    asks = np.flatnonzero(member != count.argmax())
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.cumsum(often)
    posting = owner[np.argsort(token, kind="stable")]
    first = np.cumsum(sizes) - sizes
    out_a, out_b = [], []
    for i in asks.tolist():
        own = token[first[i] : first[i] + sizes[i]]
        own = own[often[own] > 1]
        n = often[own]
        if not len(own):
            continue
        at = np.repeat(ends[own] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
        same = np.bincount(posting[at], minlength=len(sets))
        hit = np.flatnonzero((100 * same >= percent * (sizes[i] + sizes - same)) & (comp != comp[i]))
        out_a.append(np.full(len(hit), node[i]))
        out_b.append(node[hit])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)
