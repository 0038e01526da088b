"""Raw pages: landing table and its readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def land(pages: DataFrame, root: str) -> None:
    """Land raw pages by date and kind; the content hash tells copies apart.

    ``pages`` carry date, source_kind, source_url, html. Copies landed by other runs drop out in ``read``.
    """
    hashed = pages.withColumn("content_hash", F.sha2("html", 256))
    once = hashed.groupBy("date", "source_kind", "content_hash").agg(F.min_by(F.struct("source_url", "html"), "source_url").alias("p"))
    # a day's pages of a kind lie together, else every task would leave a file below every day
    together = once.select("date", "source_kind", "content_hash", "p.*").hint("rebalance", F.col("date"), F.col("source_kind"))
    together.write.mode("append").partitionBy("date", "source_kind").parquet(root)


def read(spark: SparkSession, root: str, source_kind: str = "", date_from: str = "", date_to: str = "") -> DataFrame:
    """Landed pages; kind and dates prune partitions."""
    rows = spark.read.parquet(root).withColumn("date", F.col("date").cast("string"))
    if source_kind:
        rows = rows.where(F.col("source_kind") == source_kind)
    if date_from:
        rows = rows.where(F.col("date") >= date_from)
    if date_to:
        rows = rows.where(F.col("date") <= date_to)
    rest = F.struct("source_url", "html")
    once = rows.groupBy("date", "source_kind", "content_hash").agg(F.min_by(rest, "source_url").alias("p"))
    return once.select("date", "source_kind", "content_hash", "p.*")
