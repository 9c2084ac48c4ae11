"""Registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.llm import bitsliced_simhash, bounded_ring, hamming_minhash, merkle_manifest, mtree_topk, piecewise_hash, prefix_trie, sentencepiece_bpe, subword_quality, suffix_radix, token_files, vector_packing, wrapper_html
from modelgauge.llm.common import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = stored(vector_packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    return vector_packing.pack(parts)


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_ring.shard_documents(table(spark, sf_dir, "documents"))


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_minhash.near_components(table(spark, sf_dir, "documents"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = subword_quality.learn(docs, table(spark, sf_dir, "labels"))
    return subword_quality.score(docs, model).select("doc_id", subword_quality.held_out().alias("held_out"), "score", "predicted")


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_radix.digests(suffix_radix.remove_repeats(table(spark, sf_dir, "documents")))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper_html.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piecewise_hash.compare(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced_simhash.near_components(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


ORACLE["op6_exact_top_k"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 5"""

ORACLE["op4_near_duplicates"] = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(sh) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1),
l AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY 1) c ON c.node = n.doc_id"""

#: CRC-32 of the decimal digits of {x}, bit by bit: every digit comes with seven further steps.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda ch: list_prepend(CAST(ascii(ch) AS BIGINT), list_transform(range(7), lambda i: CAST(-1 AS BIGINT)))))),
  lambda a, e: CASE WHEN (CASE WHEN e >= 0 THEN xor(a, e) ELSE a END) & 1 = 1 THEN xor((CASE WHEN e >= 0 THEN xor(a, e) ELSE a END) >> 1, 3988292384) ELSE (CASE WHEN e >= 0 THEN xor(a, e) ELSE a END) >> 1 END))"""

ORACLE["op12_prefix_trie"] = f"""WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format(x="conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS own, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
t AS (SELECT conv_id, strlen(text) AS bytes, row_number() OVER w AS depth, string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
a AS (SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS path, CAST(NULL AS VARCHAR) AS up FROM c UNION ALL SELECT conv_id, depth, bytes, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY depth), '') FROM t),
n AS MATERIALIZED (SELECT path, any_value(up) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs FROM a GROUP BY path),
k AS (SELECT up AS path, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT v.path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved FROM n v JOIN n u ON starts_with(u.path, v.path) LEFT JOIN k ON k.path = u.path GROUP BY 1),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM a GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path) LEFT JOIN n p ON p.path = n.up"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(added: int) -> str:
    return "sha256(" + " || ".join(_field(f"CAST({v} AS VARCHAR)") for v in ("doc_id", "source", "lang", f"(CAST(n_chars AS HUGEINT) + {added})", "text")) + ")"


def _folded(nodes: str, pos: str) -> str:
    """Folding steps and siblings of the place `pos` in a tree's levels, from the lowest."""
    at = f"({pos} >> (l - 1))"
    sibling = f"coalesce({nodes}[l][xor({at}, 1) + 1], '')"
    return f"list_transform(range(1, len({nodes})), lambda l: CASE WHEN {at} & 1 = 1 THEN 'L' ELSE 'R' END || {sibling})"


_UP = "list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"

ORACLE["op13_merkle_manifest"] = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, {_leaf(0)} AS leaf, CASE WHEN {_CRC.format(x="doc_id")} % 7 = 0 THEN {_leaf(1)} ELSE {_leaf(0)} END AS start FROM documents),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t(lang, height, nodes) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM b GROUP BY lang UNION ALL SELECT lang, height + 1, {_UP} FROM t WHERE len(nodes) > 1),
f AS MATERIALIZED (SELECT lang, list(nodes ORDER BY height) AS levels, arg_max(nodes, height)[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t GROUP BY lang),
u(height, nodes) AS (SELECT 0, list(subroot ORDER BY place) FROM f UNION ALL SELECT height + 1, {_UP} FROM u WHERE len(nodes) > 1),
g AS (SELECT list(nodes ORDER BY height) AS levels, arg_max(nodes, height)[1] AS root FROM u),
p AS (SELECT b.doc_id, b.leaf, b.start, f.subroot, g.root, {_folded("f.levels", "b.pos")} || {_folded("g.levels", "f.place")} AS steps FROM b JOIN f ON f.lang IS NOT DISTINCT FROM b.lang CROSS JOIN g)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT *, list_reduce(list_prepend(start, steps), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded FROM p)"""
