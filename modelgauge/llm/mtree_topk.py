"""Exact top-k inner products by best-first search in M-trees.

Inner product is no metric, so vectors get one more component that gives all of them the same norm R (queries get 0 there): the nearest
vectors in Euclidean distance are then those with the largest inner product, |q - x|^2 = |q|^2 + R^2 - 2 q.x.

The top level of the tree is a set of routing vectors with covering radii, which grows with the root of the number of rows; below each, its vectors
are dealt into parts of bounded size, each holding an M-tree of pages. A page's entries have a vector, a covering radius and the distance to the page's own routing vector. The search takes
the page with the best bound first; the triangle inequality over stored parent distances skips entries without computing their distance,
and covering radii skip pages.

A query first searches the part nearest to it. Its k-th score then rules out most routing vectors; the parts under the others are searched with
that score as the bar to beat. The pages of a part are sent once to every QUERY_BLOCK queries that have to search it, and queries stream past them, so
shuffled bytes and held rows follow the searches that are needed.

Components are floor(256 * x). Vectors that are null or hold null, NaN or infinite components, and rows without an id, take no part; shorter vectors are
filled up with zeros. Rows with the query's own id are no candidates. Equal query rows count once. Scores are exact for components up to 2**20.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelgauge.llm.common import stored

SCALE = 256
ROUTES = 64
#: One routing vector for so many roots of the number of rows, ROUTES at least.
ROOTS = 4
VISITS = 5000
PART_ROWS = 4096
LEAF = 96
FAN_OUT = 12
QUERY_BLOCK = 2000
PAGE = "part string, page int, leaf boolean, ids binary, vectors binary, radii binary, back binary"


def _quantised(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, norms = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is None or v is None or None in v:
                    continue
                x = np.zeros(dim)
                x[: len(v)] = v
                x = np.floor(SCALE * x)
                if np.isfinite(x).all():
                    ids.append(i)
                    rows.append(x.tobytes())
                    norms.append(float(x @ x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "v", "norm"])

    return run


def lifted(rows: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component, all of squared norm `top`."""
    return np.hstack([rows, np.sqrt(np.maximum(top - (rows * rows).sum(axis=1), 0))[:, None]])


def distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    gap = rows - one
    return np.sqrt((gap * gap).sum(axis=1))


def _routed(routes: np.ndarray, top: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nearest routing vector of every row, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                rows = lifted(_rows(batch.column("v").to_pylist()), top)
                all_ = np.stack([distances(rows, r) for r in routes], axis=1)
                near = all_.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(all_[np.arange(len(near)), near])], [*batch.schema.names, "route", "far"])

    return run


def _rows(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=np.float64).reshape(len(cells), -1)


def build(part: str, ids: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """Pages of an M-tree over `rows`; page 0 is the root."""
    pages: list[tuple] = []

    def place(chosen: np.ndarray, center: np.ndarray) -> int:
        at = len(pages)
        pages.append(())
        if len(chosen) <= LEAF:
            zero = np.zeros(len(chosen))
            pages[at] = (part, at, True, ids[chosen].tobytes(), rows[chosen].tobytes(), zero.tobytes(), distances(rows[chosen], center).tobytes())
            return at
        seeds, gap = [0], distances(rows[chosen], rows[chosen[0]])
        nearest = np.zeros(len(chosen), dtype=np.int64)
        while len(seeds) < FAN_OUT and gap.max() > 0:  # farthest first
            seeds.append(int(gap.argmax()))
            own = distances(rows[chosen], rows[chosen[seeds[-1]]])
            nearest[own < gap] = len(seeds) - 1
            gap = np.minimum(gap, own)
        if len(seeds) == 1:  # all equal: cut evenly
            nearest = np.arange(len(chosen)) * FAN_OUT // len(chosen)
            seeds = seeds * FAN_OUT
        kids, objects, radii = [], [], []
        for s, seed in enumerate(seeds):
            group = chosen[nearest == s]
            if len(group):
                middle = rows[chosen[seed]]
                objects.append(middle)
                radii.append(distances(rows[group], middle).max())
                kids.append(place(group, middle))
        inner = np.array(objects)
        pages[at] = (part, at, False, np.array(kids, np.int64).tobytes(), inner.tobytes(), np.array(radii).tobytes(), distances(inner, center).tobytes())
        return at

    if len(rows):
        place(np.arange(len(rows)), rows[0])
    return pages


class Tree:
    def __init__(self, pages: pd.DataFrame, width: int, top: float):
        self.top = top
        self.pages = {
            p.page: (p.leaf, np.frombuffer(p.ids, np.int64), np.frombuffer(p.vectors, np.float64).reshape(-1, width), np.frombuffer(p.radii, np.float64), np.frombuffer(p.back, np.float64))
            for p in pages.itertuples()
        }

    def search(self, q: np.ndarray, own: int, k: int, bar: float) -> list[tuple[int, int]]:
        """(score, id) of the best k rows scoring at least `bar`, without id `own`."""
        norm = float(q @ q)
        both = norm + self.top
        slack = 0.25 + 1e-9 * both
        query = np.append(q, 0.0)
        best: list[tuple[float, int]] = []  # heap of (score, -id)
        todo: list[tuple[float, int, float]] = [(-math.inf, 0, -1.0)]
        while todo:
            bound, page, to_center = heapq.heappop(todo)
            if -bound < bar - slack:
                break
            leaf, ids, rows, radii, back = self.pages[page]
            if to_center >= 0 and bar > -math.inf:
                least = np.maximum(np.abs(to_center - back) - radii, 0)
                keep = np.flatnonzero(both - least * least >= 2 * (bar - slack))
                if len(keep) < len(ids):
                    ids, rows, radii = ids[keep], rows[keep], radii[keep]
            if not len(ids):
                continue
            product = rows @ query
            if leaf:
                for i in np.flatnonzero(product >= bar) if bar > -math.inf else range(len(ids)):
                    if ids[i] == own:
                        continue
                    entry = (float(product[i]), -int(ids[i]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    bar = max(bar, best[0][0])
            else:
                away = np.sqrt(np.maximum(both - 2 * product, 0))
                least = np.maximum(away - radii, 0)
                bounds = (both - least * least) / 2
                for i in np.flatnonzero(bounds >= bar - slack):
                    heapq.heappush(todo, (-float(bounds[i]), int(ids[i]), float(away[i])))
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `vectors` for every row of `queries` (vec_id, embedding)."""
    spark = vectors.sparkSession
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(dim, 1)
    quantised = lambda rows: rows.select("vec_id", "embedding").mapInArrow(_quantised(width), "vec_id long, v binary, norm double")
    table = stored(quantised(vectors), "vectors")
    asks = stored(quantised(queries).dropDuplicates(["vec_id", "v"]), "asks")
    top, rows = table.agg(F.max("norm"), F.count("*")).first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = max(ROUTES, math.isqrt(rows) // ROOTS)
    seeds = [r[0] for r in table.groupBy("v").agg(F.min("vec_id").alias("i")).orderBy(F.xxhash64("v")).limit(most).select("v").collect()]
    routes = lifted(_rows(seeds), top)
    placed = table.mapInArrow(_routed(routes, top), "vec_id long, v binary, norm double, route int, far double")
    found = placed.groupBy("route").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each routing vector
    parts = {r["route"]: -(-r["n"] // PART_ROWS) for r in found}
    radius = {r["route"]: r["far"] for r in found}
    cut = spark.createDataFrame(sorted(parts.items()), "route int, parts long")
    part = F.concat_ws("/", "route", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    pages = stored(placed.join(cut, "route").select("vec_id", "v", part.alias("part")).groupBy("part").applyInPandas(_builder(top), PAGE), "pages")

    named = asks.select("vec_id", "v").mapInArrow(_visits(routes, top, parts, None), "query_id long, q binary, part string, bar double")
    first = stored(_search(pages, named, width, top, k), "first")
    bars = first.groupBy("query_id", "q").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
    rest = asks.join(bars.withColumnsRenamed({"query_id": "vec_id", "q": "v"}), ["vec_id", "v"], "left")
    rest = rest.select("vec_id", "v", F.col("bar").cast("double")).mapInArrow(_visits(routes, top, parts, radius), "query_id long, q binary, part string, bar double")
    every = first.union(_search(pages, rest, width, top, k))
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _builder(top: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        return pd.DataFrame(build(group["part"].iloc[0], group["vec_id"].to_numpy(), lifted(_rows(list(group["v"])), top)), columns=[c.split()[0] for c in PAGE.split(", ")])

    return run


def _visits(routes: np.ndarray, top: float, parts: dict[int, int], radius: dict[int, float] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parts a query has to search: one of its nearest route's (no `radius`), or all others that its bar doesn't rule out."""
    live = np.array(sorted(parts))
    types = (pa.int64(), pa.binary(), pa.string(), pa.float64())

    def batch_of(out: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["query_id", "q", "part", "bar"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            names = batch.schema.names
            for i, v, bar in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), batch.column("bar").to_pylist() if "bar" in names else [None] * batch.num_rows, strict=True):
                q = np.frombuffer(v, np.float64)
                both = float(q @ q) + top
                away = distances(routes[live], np.append(q, 0.0))
                home = int(live[away.argmin()])
                first = f"{home}/{i % parts[home]}"
                bar = -math.inf if bar is None else bar
                if radius is None:
                    wanted = [first]
                else:
                    wanted = []
                    for r, d in zip(live.tolist(), away.tolist(), strict=True):
                        least = max(0.0, d - radius[r] * (1 + 1e-9))
                        if (both - least * least) / 2 >= bar - 0.25 - 1e-9 * both:
                            wanted += [f"{r}/{p}" for p in range(parts[r]) if f"{r}/{p}" != first]
                for p in wanted:
                    for column, x in zip(out, (i, v, p, bar), strict=True):
                        column.append(x)
                    if len(out[0]) >= VISITS:
                        yield batch_of(out)
                        out = ([], [], [], [])
            yield batch_of(out)

    return run


def _found(width: int, top: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers of queries that stream past the pages of their part: rows sorted by part, block and kind, pages (kind 0) first."""
    names, types = ["query_id", "q", "vec_id", "score"], (pa.int64(), pa.binary(), pa.int64(), pa.int64())
    cells = [c.split()[0] for c in PAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pages, tree = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if (row["part"], row["block"]) != at:
                        at, pages, tree = (row["part"], row["block"]), [], None
                    pages.append([row[c] for c in cells])
                    continue
                if tree is None:
                    tree = Tree(pd.DataFrame(pages, columns=cells), width + 1, top)
                out += [(row["query_id"], row["q"], i, s) for s, i in tree.search(np.frombuffer(row["q"], np.float64), row["query_id"], k, row["bar"])]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)

    return run


def _search(pages: DataFrame, visits: DataFrame, width: int, top: float, k: int) -> DataFrame:
    """query_id, q, vec_id, score: up to k rows of every part that a query visits (query_id, q, part, bar)."""
    visits = stored(visits, "visits")
    blocks = visits.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    sent = pages.join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("kind", F.lit(0))
    asked = visits.join(blocks, "part").withColumns({"block": F.pmod(F.xxhash64("query_id", "q"), F.col("blocks")).cast("int"), "kind": F.lit(1)})
    both = sent.drop("blocks").unionByName(asked.drop("blocks"), allowMissingColumns=True)
    dealt = both.repartition("part", "block").sortWithinPartitions("part", "block", "kind")
    return dealt.mapInArrow(_found(width, top, k), "query_id long, q binary, vec_id long, score long")
