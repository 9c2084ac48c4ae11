"""Merkle manifest of a table: every row a leaf, one tree for each language, one tree over the languages, and a proof for every leaf.

H is the lowercase hexadecimal SHA-256 of its inputs one after the other; digests enter as hexadecimal text and are kept as 32 bytes.
A leaf is H of the fields, each "-" if null, else its number of UTF-8 bytes, ":" and its value. Leaves of a language ascend by the id
(null first; rows with the same id by their leaf, equal rows are leaves of their own). A null language is one of its own and comes
first. A missing partner is left out of H. A single leaf is its own subroot; with one language its subroot is the root; a leaf without
any sibling has the proof of no input. Only the named columns are read, so further columns may have any name. An empty table has no
row. Long texts are hashed in the scan and never shuffled.

The levels are built bottom-up and stored as node rows. A row holds LEVELS levels over 64 neighbouring nodes and the link to its
parent row (row name and place there); the top row of a language links to the tree over the languages. Proofs are a Spark recursive
query: every leaf climbs from row to row along the parent links, appends the siblings and folds its (possibly tampered) hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.llm.common import ranked, stored

LEVELS = 6
WIDTH = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """32 bytes of H."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def text_of(hashed: Column) -> Column:
    return F.lower(F.hex(hashed))


def _fields(values: Sequence[Column]) -> list[Column]:
    written = [v.cast("string") for v in values]
    return [F.when(w.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(w).cast("string"), F.lit(":"), w)) for w in written]


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and the leaf as a tampered table would have it: n_chars one higher where 7 divides the id's CRC-32."""
    n_chars = F.col("n_chars").cast("decimal(38,0)")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0

    def leaf(n: Column) -> Column:
        return digest(*_fields([n if f == "n_chars" else F.col(f) for f in FIELDS]))

    changed = F.when(tampered & n_chars.isNotNull(), leaf(n_chars + 1))
    return docs.select("doc_id", "lang", leaf(n_chars).alias("leaf"), changed.alias("changed"))


def _pairs(level: str) -> Column:
    """The level above the array column `level`."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")),
        lambda i: digest(text_of(F.get(level, i * 2)), F.coalesce(text_of(F.get(level, i * 2 + 1)), F.lit(""))),
    )


def height(n: Column) -> Column:
    """Levels over n nodes: the least h with 2 ** h >= n."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))).cast("int")


def node_rows(nodes: DataFrame, tallest: int) -> list[DataFrame]:
    """Stored rows of the trees whose lowest nodes are `nodes` (tree, pos, n, hash), one table for every LEVELS levels.

    tile: name of the row; below: its levels, lowest first, without the highest; top: the highest node; done: nothing stands above.
    """
    out = []
    nodes = nodes.withColumn("height", height(F.col("n"))).drop("n")
    for step in range(max(1, -(-tallest // LEVELS))):
        cell = F.struct((F.col("pos") % WIDTH).alias("slot"), "hash")
        rows = nodes.groupBy("tree", F.floor(F.col("pos") / WIDTH).alias("at"), "height").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        rows = rows.select("tree", "at", "height", F.transform("cells", lambda c: c["hash"]).alias("l0"))
        for k in range(LEVELS):
            here = F.col("height") > step * LEVELS + k
            rows = rows.withColumn(f"l{k + 1}", F.when(here, _pairs(f"l{k}")))
        rows = rows.withColumns({
            "below": F.filter(F.array(*(F.when(F.col(f"l{k + 1}").isNotNull(), F.col(f"l{k}")) for k in range(LEVELS))), lambda x: x.isNotNull()),
            "top": F.get(F.coalesce(*(F.col(f"l{k}") for k in range(LEVELS, -1, -1))), F.lit(0)),
            "done": F.col("height") <= (step + 1) * LEVELS,
        })
        rows = rows.select(tile("tree", F.lit(step), F.col("at")).alias("tile"), "tree", "at", "height", "below", "top", "done")
        out.append(stored(rows, "merkle-nodes"))
        nodes = out[-1].where(~F.col("done")).select("tree", F.col("at").alias("pos"), "height", F.col("top").alias("hash"))
    return out


def tile(tree: str, step: Column, at: Column) -> Column:
    return F.concat_ws("/", tree, step.cast("string"), at.cast("string"))


def linked(levels: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """tile, below, parent, slot of all rows; `above` (tree, pos) is the place of a finished tree in the next one, whose name is "root"."""
    out = None
    for step, rows in enumerate(levels):
        up = tile("tree", F.lit(step + 1), F.floor(F.col("at") / WIDTH))
        inner = rows.where(~F.col("done")).select("tile", "below", up.alias("parent"), (F.col("at") % WIDTH).cast("int").alias("slot"))
        ended = rows.where("done")
        if above is None:
            ended = ended.select("tile", "below", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("slot"))
        else:
            first = F.concat(F.lit("root/0/"), F.floor(F.col("pos") / WIDTH).cast("string"))
            ended = ended.join(above, "tree").select("tile", "below", first.alias("parent"), (F.col("pos") % WIDTH).cast("int").alias("slot"))
        both = inner.union(ended)
        out = both if out is None else out.union(both)
    return out


CLIMB = """WITH RECURSIVE climb(doc_id, tree, leaf, tile, slot, folded, siblings) AS (
  SELECT doc_id, tree, leaf, tile, slot, start, CAST('' AS BINARY) FROM {leaves}
  UNION ALL
  SELECT doc_id, tree, leaf, parent, up, ends.hash, ends.siblings FROM (
    SELECT c.doc_id, c.tree, c.leaf, n.parent, n.slot AS up, aggregate(n.below,
      named_struct('hash', c.folded, 'siblings', c.siblings, 'at', c.slot),
      (s, level) -> named_struct(
        'hash', unhex(sha2(concat(
          CASE WHEN s.at % 2 = 1 THEN lower(hex(get(level, s.at - 1))) ELSE '' END, lower(hex(s.hash)),
          CASE WHEN s.at % 2 = 0 THEN coalesce(lower(hex(get(level, s.at + 1))), '') ELSE '' END), 256)),
        'siblings', concat(s.siblings, coalesce(get(level, s.at ^ 1), CAST('' AS BINARY))),
        'at', shiftright(s.at, 1))) AS ends
    FROM climb c JOIN {nodes} n ON c.tile = n.tile))
SELECT doc_id, tree, leaf, folded, siblings FROM climb WHERE tile IS NULL"""

#: The recursion ends at the root; Spark's own guard of a million rows in all does not hold for a table of any size.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climbed(spark: SparkSession, start: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, tree, leaf, folded, siblings of every leaf of `start` (doc_id, tree, leaf, tile, slot, start), written once."""
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return stored(spark.sql(CLIMB, leaves=start, nodes=nodes), "merkle-proofs")
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of `docs` (doc_id, source, lang, n_chars, text)."""
    spark = docs.sparkSession
    hashed = ranked(leaves(docs), ["lang"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")], ["doc_id", "lang", "leaf", "changed"], "merkle-leaves")
    langs = hashed.groupBy("lang").agg(F.max("n").alias("rows"))
    langs = stored(ranked(langs, [], [F.col("lang").asc_nulls_first()], ["lang", "rows"], "merkle-order").withColumn("tree", F.col("pos").cast("string")), "merkle-langs")
    place = langs.select(F.col("lang").alias("_lang"), "tree")
    rows = stored(hashed.join(place, hashed["lang"].eqNullSafe(place["_lang"])).select("doc_id", "tree", "leaf", "changed", "pos", "n"), "merkle-leaves")
    most = langs.agg(F.max(height(F.col("rows"))), F.max(height(F.col("n")))).first()
    levels = node_rows(rows.select("tree", "pos", "n", F.col("leaf").alias("hash")), most[0] or 0)
    subroots = levels[0].where("done")
    for more in levels[1:]:
        subroots = subroots.union(more.where("done"))
    subroots = stored(subroots.select("tree", F.col("top").alias("hash")), "merkle-subroots")
    top = node_rows(langs.select("tree", "pos", "n").join(subroots, "tree").select(F.lit("root").alias("tree"), "pos", "n", "hash"), most[1] or 0)
    nodes = stored(linked(levels, langs.select("tree", "pos")).union(linked(top, None)), "merkle-nodes")
    start = rows.select("doc_id", "tree", "leaf", tile("tree", F.lit(0), F.floor(F.col("pos") / WIDTH)).alias("tile"), (F.col("pos") % WIDTH).cast("int").alias("slot"), F.coalesce("changed", "leaf").alias("start"))
    proofs = climbed(spark, start, nodes)
    ends = top[-1].where("done").select("top").first()  # one row: the root
    root = F.lit(ends[0].hex() if ends else None).cast("string")
    out = proofs.join(subroots, "tree").select("doc_id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("hash")).alias("subroot"), root.alias("root"), F.sha2(text_of(F.col("siblings")), 256).alias("proof_sha256"), text_of(F.col("folded")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
