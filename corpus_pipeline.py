"""Documents to training mix: language, exact copies, near copies, test passages, source weights.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with all their columns; the last
one returns the documents of the mix with their sizes and the words the mix takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.llm import decontaminate, exact, language, mixing, near
from pagelight.llm.queries import as_blocks, earlier_half, golden
from pagelight.llm.storage import shared_folder


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of id and text, so that stages decide on rows: a null id is no exception, a shared id no bond."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def keyed_blocks(docs: DataFrame) -> DataFrame:
    """The text blocks of keyed ``docs``, the key for an id."""
    return as_blocks(docs.withColumn("doc_id", F.col("__key")))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed ``docs`` less those whose key is in ``keys`` as doc_id."""
    gone = keys.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("__key") == F.col("__gone"), "left_anti").drop("__key")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without a letter and those of no known language go."""
    docs = keyed(docs.filter(language.has_letters(F.col("text"))))
    block = keyed_blocks(docs)
    return without(docs, language.identify(block, language.fit(block)).filter("rejected"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the smallest doc_id; a repeated row stays once."""
    block = as_blocks(docs)
    found = exact.exact_duplicates(block, earlier_half(block)).filter("kept")
    kept = found.select(F.col("doc_id").alias("__kept"), F.col("digest").alias("__text")).distinct()
    mark = exact.digest("text")
    same = F.col("__digest") == F.col("__text")
    return (
        docs.withColumn("__digest", mark)
        .join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")) & same, "left_semi")
        .dropDuplicates(["doc_id", "__digest"]).drop("__digest")
    )


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, a null one last."""
    docs = keyed(docs)
    group = near.near_duplicates(keyed_blocks(docs)).select(F.col("doc_id").alias("__key"), "group_id").distinct()
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__key").alias("key"))
    first = docs.select("__key", place.alias("place")).join(group, "__key").groupBy("group_id").agg(F.min("place").alias("first"))
    return docs.join(first.select(F.col("first.key").alias("__stays")), F.col("__key") == F.col("__stays"), "left_semi").drop("__key")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test passage."""
    docs = keyed(docs)
    return without(docs, decontaminate.contained_passages(keyed_blocks(docs), golden(spark, sf_dir)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with the words taken of them; rows that share doc_id, source and size count alike."""
    mixed = mixing.mix(as_blocks(docs)).filter("taken > 0").groupBy("doc_id", "source", "size").agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("taken").alias("taken"))
    mixed = mixed.select(F.struct("doc_id", "source", "size").alias("__key"), "size", "source_size", "target", "taken")
    key = F.struct("doc_id", "source", mixing.word_count("text").alias("size"))
    return docs.select("doc_id", "text", "lang", "source", key.alias("__key")).join(mixed, "__key").drop("__key")


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", keep_one_copy),
    ("near_duplicates", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The language stage is a trained model; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is stored in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
