"""The corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; the driver of the pipeline writes what a stage
returns as Parquet and reads it again for the next.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.ngram_join import ngram_join
from forkline.llm.packing import packed
from forkline.llm.quality import described, held_out, kept, trained
from forkline.llm.queries import BYTE_BPE, tokenizer
from forkline.llm.substring_dedup import substring_dedup
from forkline.session import materialised, tables


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more); it learns from labels that are not held out.

    Statistics are made where the texts are read and only they meet the labels: that costs CPU time for texts without a
    label, but no text is shuffled.
    """
    statistics = described(docs.where(~held_out(F.col("doc_id"))))
    return kept(docs, trained(statistics, tables(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id; of several unlike the others with that id, all.

    Rows of one doc_id and one text are one document.  Where several texts of a group have its least doc_id, one with the
    least hash stays.  Blank texts, which are near duplicates of nothing, and rows without doc_id, which cannot be told
    apart, stay.
    """
    key = F.xxhash64("text").alias("key")
    found = materialised(ngram_join(docs.where("doc_id is not null").select("doc_id", "text", key), carry="key"))
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.doc_id", "first.key")
    keep = materialised(first.union(found.where("component is null").select("doc_id", "key")).distinct())
    name = "key"
    while name in docs.columns:
        name += "_"
    once = docs.withColumn(name, F.xxhash64("text")).join(keep.withColumnRenamed("key", name), ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat from documents of smaller doc_id.

    A text that loses words is its other words joined by one space, and n_chars their length; other rows stay as they are.
    """
    out = substring_dedup(docs, carry=tuple(docs.columns))
    old = {c: F.col(f"carried.c{k}") for k, c in enumerate(docs.columns)}
    new = {"text": F.col("kept_text")} | ({"n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in old else {})
    return out.select(*[F.when(F.col("n_removed") > 0, new[c]).otherwise(o).alias(c) if c in new else o.alias(c) for c, o in old.items()])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048: see forkline.llm.packing."""
    out = packed(docs, tokenizer(BYTE_BPE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written as Parquet in the shared folder and read again."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
