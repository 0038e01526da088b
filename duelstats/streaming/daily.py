"""Daily outcome counts per deck, maintained from a stream of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from duelstats.operators.stats import COUNTS, result_counts

KEYS = ["day", "deck"]


def daily_counts(results: DataFrame) -> DataFrame:
    """Counts per UTC day and deck of (ts, deck, result)."""
    counted = results.groupBy(F.window("ts", "1 day").alias("w"), "deck").agg(*result_counts(F.col("result")))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "deck", *COUNTS)


def maintain(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the counts of each batch; a batch that is retried replaces its own partition.

    Counts add up, so the stream keeps no state and needs no watermark: a row counts however late it arrives.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = daily_counts(batch).withColumn("seq", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seq").parquet(path)

    stream = results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Counts per day and deck over all batches."""
    return spark.read.parquet(path).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])
