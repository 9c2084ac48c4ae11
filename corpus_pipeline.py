"""Corpus pipeline: quality filter, near-duplicate removal, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next stage's
docs. All but the last return the columns of `documents`; extra columns travel along unchanged whatever their names. A null text
becomes empty where passages are cut. Rows that repeat a doc_id with the same text are one document. Rows without a doc_id
cannot stand for a group of near duplicates: of those with the same text one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.llm import hamming_minhash, subword_quality, suffix_radix, vector_packing
from modelgauge.llm.common import stored

PASSAGE_WORDS = 50


def _others(docs: DataFrame) -> Column:
    return F.struct(*(c for c in docs.columns if c != "text")).alias("others")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is under the threshold."""
    model = subword_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = subword_quality.score(docs.select(_others(docs), "text"), model, ("others",), with_text=True)
    return scored.where("predicted = 1").select("others.*", "text").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near duplicates, once."""
    groups = hamming_minhash.near_components(docs.select("doc_id", "text"))
    kept = groups.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of PASSAGE_WORDS words or more that also stands anywhere else, the same document included, out of the texts.

    All copies of a passage go, the first one too; white space between the words does not count, the white space behind a passage goes
    with it. The stage works on words because passages are meant to be runs of words: in bytes a threshold would depend on the language.
    """
    cut = suffix_radix.remove_repeats(docs.select(_others(docs), "doc_id", "text"), PASSAGE_WORDS, keep=("others",), as_text=True, unit=suffix_radix.WORDS)
    out = cut.select("others.*", F.col("kept_text").alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every token piece of every document in sequences of 1024 tokens."""
    return vector_packing.pack(stored(vector_packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: No SQL: a trained model, exact tokenisation and byte windows take part; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
