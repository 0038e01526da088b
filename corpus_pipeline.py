"""Corpus pipeline: the stages that turn raw documents into a training mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelstats.llm import content_sort, mixing, near_dedup, phrase_index, toxicity
from duelstats.llm.base import land, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the machine is fitted on the labelled ones among them."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, that with the largest identifier."""
    return content_sort.exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.without_near(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much of a benchmark passage."""
    landed = land(docs.select(F.monotonically_increasing_id().alias("_row_number"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    flat = landed.select("_row_number", F.col("_row").getField("text").alias("text"))
    marked = phrase_index.contamination(flat, table(spark, sf_dir, "benchmark"), id_col="_row_number")
    bad = marked.where("_contaminated").select(F.col("_id").alias("_row_number"))
    return landed.join(bad, "_row_number", "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes and how many of their words, repeats counted."""
    mixed = mixing.mix(docs).where("_copies > 0")
    return mixed.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]
ORACLE_SQL = None  # the first stage's machine and the third's sampling are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each over all that the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
