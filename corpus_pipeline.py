"""A training corpus from ``documents``: identify languages, drop near copies, cut repeats, mix sources, pack sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import Scratch, table
from termloom.llm.jaccard_join import jaccard_join
from termloom.llm.language import identify, learn
from termloom.llm.mixing import mix
from termloom.llm.packing import pack
from termloom.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those whose nearest codeword is in doubt, go. A missing lang becomes the prediction.

    Null and repeated ids are rows like others. Without a row that has text and lang nothing can be told, so all go.
    """
    docs = docs.select(*COLUMNS)
    model = learn(docs.where("lang is not null and text is not null").select("doc_id", "text", "lang"))
    found = identify(docs, model, tuple(COLUMNS)).where("lang_pred <> 'und' and not ambiguous")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; rows without an id stay, uncompared.

    A row is known by all its columns, so texts under one repeated id fare apart; wholly equal rows are one.
    """
    docs = docs.select(*COLUMNS)
    rows = docs.where("doc_id is not null").withColumn("_key", F.xxhash64(*COLUMNS))
    groups = jaccard_join(rows.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    least = rows.select("_key", "doc_id").distinct().join(groups, "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("_least"))
    kept = rows.join(least.select("_least._key"), "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; a document of which nothing but white space is left goes.

    A document that had no word to begin with stays, null texts as empty ones. Null and repeated ids are rows like others.
    """
    rest = ("doc_id", "lang", "source", "n_chars")
    found = suffix_dedup(docs.select(*COLUMNS), rest, as_text=True)
    found = found.where((F.size("removed") == 0) | F.col("rest").rlike(r"[^\x20\x09-\x0D]"))
    return found.select("doc_id", F.col("rest").alias("text"), "lang", "source", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length("rest")).cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; of equal rows as many copies as they take together.

    Documents without a word take nothing and go. Rows with null or repeated ids are told apart by all their columns.
    """
    docs = docs.select(*COLUMNS).withColumn("_key", F.xxhash64(*COLUMNS))
    copies = mix(docs, keep=("doc_id", "_key")).groupBy("_key").agg(F.sum("copies").cast("int").alias("_n")).where("_n > 0")
    return docs.dropDuplicates(["_key"]).join(copies, "_key").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens; a null text is its end token alone.

    A document that the mix repeats is packed as often; rows with a null id are pieces with a null id.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_copies", near_copies), ("repeats", repeats), ("mixing", mixed), ("packing", packed)]

#: Learned languages, hashes and a tokenizer have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage; each stage's rows are written and read again. An empty table gives no rows."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
