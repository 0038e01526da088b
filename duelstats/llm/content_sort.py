"""Exact de-duplication by a content sort.

Sampled splitters (Spark's range partitioner over a 32-byte prefix, a 64-bit digest and a part number) deal the texts out, an
external sort puts equal texts side by side, and every text is compared in full with its neighbour. A group with more than
``part_rows`` rows is split by a hash of the identifier into parts of about that many rows; the first row of each part then meets the
others of its group in a small aggregation over the full text. So no task holds a whole group, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelstats.session import cut

PART_ROWS = 1000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Column | None = None, part_rows: int = PART_ROWS, carry: bool = False) -> DataFrame:
    """One row per input row: ``_id``, ``_keep_id``, ``_size``, ``_kept``, ``_sha`` and, with ``carry``, the input row as ``_row``.

    ``keep`` names which identifier of equal texts stays: "smallest" or "largest". ``normalise`` is the text that is compared, as a
    Column over the input; null counts as empty. Of rows that share the identifier as well, exactly one stays. Null identifiers lose
    against all others. An empty table gives an empty result; further columns, whatever their names, are left alone.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = F.coalesce(normalise if normalise is not None else F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        text.alias("_text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []),
    ).withColumn("_digest", F.xxhash64("_text"))
    many = cut(rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_rows).select("_digest", F.ceil(F.col("_n") / part_rows).alias("_parts")))
    dealt = rows.join(many, "_digest", "left").withColumn("_part", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_id"), F.col("_parts")) + 1))
    keys = ["_prefix", "_digest", "_part"]
    dealt = dealt.withColumn("_prefix", F.substring(F.encode("_text", "UTF-8"), 1, 32)).drop("_parts").repartitionByRange(*keys)

    best = F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_last()
    side_by_side = Window.partitionBy(*keys).orderBy("_text", best)
    is_new = F.lag("_text").over(side_by_side).isNull() | (F.lag("_text").over(side_by_side) != F.col("_text"))
    run = Window.partitionBy(*keys, "_run")
    compared = (
        dealt.withColumn("_new", is_new)
        .withColumn("_run", F.sum(F.col("_new").cast("int")).over(side_by_side.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_sha", F.sha2(F.encode("_text", "UTF-8"), 256))
        # only the first row of a part takes its text along, to meet the other parts of its group
        .withColumn("_text", F.when(F.col("_new") & (F.col("_part") > 0), F.col("_text")))
        .withColumn("_size", F.count(F.lit(1)).over(run))
        .withColumn("_keep_id", F.first("_id").over(run.orderBy(F.col("_new").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    compared = cut(compared.drop("_prefix"))
    whole = compared.where(F.col("_part") == 0).withColumn("_kept", F.col("_new"))

    parts = compared.where((F.col("_part") > 0) & F.col("_new"))
    best_id = F.max("_keep_id") if keep == "largest" else F.min("_keep_id")
    groups = parts.groupBy("_digest", "_text").agg(F.sum("_size").alias("_total"), best_id.alias("_best"))
    totals = parts.join(groups, ["_digest", "_text"]).select("_digest", "_part", "_run", "_total", "_best")
    split = (
        compared.where(F.col("_part") > 0)
        .join(totals, ["_digest", "_part", "_run"])
        .withColumn("_kept", F.col("_new") & (F.col("_id").eqNullSafe(F.col("_best"))))
        .withColumn("_size", F.col("_total"))
        .withColumn("_keep_id", F.col("_best"))
    )
    out = ["_id", "_keep_id", "_size", "_kept", "_sha"] + (["_row"] if carry else [])
    return whole.select(*out).unionByName(split.select(*out))


def exact_dedup(docs: DataFrame, **kw) -> DataFrame:
    """The documents without repeats, with the columns they came with."""
    kept = exact_groups(docs, carry=True, **kw).where("_kept")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
