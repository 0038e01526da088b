"""Row numbers over data of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelstats.session import cut


def ranked(df: DataFrame, boards: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of every board in ``order``, however long one board is.

    A window would put a whole board into one task. Here one range shuffle sorts all boards at once, the sorted
    slices are written to the checkpoint folder, and the start of a board within a slice (one small row per board
    and slice) turns positions into ranks. ``order`` must be total, so that equal scores spread over slices.
    """
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(b).asc() for b in boards] + order
    sorted_slices = cut(df.repartitionByRange(slices, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    position = F.col("_id").bitwiseAND((1 << 33) - 1)
    spans = sorted_slices.groupBy(*boards, F.shiftright("_id", 33).alias("_slice")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first")
    )
    # spans hold at most (number of slices + number of boards) rows, so one board's window is short
    before = Window.partitionBy(*boards).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(
        *[F.col(b).alias(f"_b{i}") for i, b in enumerate(boards)],
        F.col("_slice").alias("_s"),
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(boards)] + [F.shiftright("_id", 33) == F.col("_s")]
    numbered = sorted_slices.join(starts, same)
    rank = F.col("_before") + position - F.col("_first") + 1
    return numbered.select(*df.columns, rank.cast("bigint").alias(name))


def top(df: DataFrame, boards: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """First ``limit`` rows per board. Spark keeps only ``limit`` rows per task before it shuffles."""
    window = Window.partitionBy(*boards).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)


def page(rows: DataFrame, sort_key: str = "sample", offset: int = 0, limit: int = 80) -> DataFrame:
    """One page of a ranked board."""
    if sort_key.strip().lower() == "sample":
        score = F.coalesce("wilson_lower_bound", F.lit(0.0))
        return rows.orderBy(F.col("sample_count").desc(), score.desc(), F.col("rank").asc()).offset(max(0, offset)).limit(limit)
    return rows.where(F.col("rank").between(max(0, offset) + 1, max(0, offset) + limit)).orderBy("rank")
