"""Mixing sources to target weights by hash thresholds.

Words are summed by source and hash bucket. Per source the bucket in which the budget runs out is found from the bucket sums and
alone divided again, ``LEVELS`` times; what remains is one threshold per source, and the documents are filtered by comparing
their hash with it. Only rows whose hash is the threshold itself, as a rule one document or its repetitions, are counted off. No other
document is sorted, and no more than ``2 ** BITS`` sums per source and level exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from duelstats.operators.ranking import ranked
from duelstats.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BITS = 12
LEVELS = 4
WORD = r"[^\x20\x09-\x0D]+"


def words(text) -> F.Column:
    """Number of words, the runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add ``_target`` to one row per source (``_key``, ``_source``, ``_source_size``).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A source stops at ``most`` times its
    size, and the excess is shared out again by weight until no target is above: with sources in the order in which they fill up,
    that is a running sum.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("_source_size") * F.lit(float(most))
    filling = Window.orderBy(full / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col("_all").cast("double") - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    heavy = F.col("_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    levels = (
        sizes.withColumn("_weight", weight)
        .withColumn("_all", F.sum("_source_size").over(everything))
        .withColumn("_weights", F.sum("_weight").over(everything))
        .withColumn("_level", left / heavy)
        .withColumn("_full", full <= F.col("_weight") * F.col("_level"))
    )
    # the first source that doesn't fill up sets the level of all that follow
    level = F.min(F.when(~F.col("_full"), F.struct((full / F.col("_weight")).alias("o"), F.col("_level").alias("l")))).over(everything)["l"]
    return levels.withColumn("_target", F.when(F.col("_full"), full).otherwise(F.col("_weight") * level)).drop("_weight", "_all", "_weights", "_level", "_full")


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Per ``_key`` the hash ``_cell`` below which rows (``_key``, ``_hash``, ``_size``) fit into ``_budget``, and what is ``_left`` of it
    for the rows with that very hash; ``_all`` where all rows fit."""
    top = bits * levels
    state = cut(budgets.select("_key", F.col("_budget").alias("_left"), F.lit(0).cast("bigint").alias("_cell"), F.lit(False).alias("_all")))
    for level in range(1, levels + 1):
        here, above = top - bits * level, top - bits * (level - 1)
        inside = rows.join(state.where(~F.col("_all") & (F.col("_left") > 0)), "_key").where(F.shiftright("_hash", above) == F.col("_cell"))
        sums = inside.groupBy("_key", F.shiftright("_hash", here).alias("_next")).agg(F.sum("_size").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_next"))
        hit = sums.withColumn("_upto", upto).join(state.select("_key", "_left"), "_key").where(F.col("_upto") > F.col("_left"))
        found = state.join(hit.groupBy("_key").agg(F.min(F.struct("_next", "_upto", "_sum")).alias("_b")), "_key", "left")
        none = F.col("_b").isNull()
        state = cut(
            found.select(
                "_key",
                F.when(none, F.col("_left")).otherwise(F.col("_left") - (F.col("_b._upto") - F.col("_b._sum"))).alias("_left"),
                F.when(none, F.shiftleft("_cell", bits)).otherwise(F.col("_b._next")).alias("_cell"),
                (F.col("_all") | (none & (F.col("_left") > 0))).alias("_all"),
            )
        )
    return state.select("_key", "_cell", "_left", "_all")


def within_budget(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (``_key``, ``_hash``, ``_size``, ``_row``, ...) with ``_in``: whether their budget takes them.

    Rows with the threshold's own hash are equal but for rare collisions; of n such rows as many are taken as bring the sum nearest to
    the budget. They are numbered over many tasks, so a row that is repeated without end does no harm.
    """
    met = rows.join(edges, "_key")
    last = met.where(~F.col("_all") & (F.col("_hash") == F.col("_cell")) & (F.col("_left") > 0))
    numbered = ranked(last.select("_key", "_row", "_size", "_left"), ["_key"], [F.col("_row").asc()], "_nth")
    taken = cut(numbered.where((F.col("_nth") - 1) * F.col("_size") + F.col("_size") / 2 < F.col("_left")).select("_row", F.lit(True).alias("_last")))
    inside = F.col("_all") | ((F.col("_hash") < F.col("_cell")) & (F.col("_left") >= 0)) | F.coalesce("_last", F.lit(False))
    return met.join(taken, "_row", "left").withColumn("_in", inside).drop("_cell", "_left", "_all", "_last")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per document: ``_id``, ``_size``, ``_source_size``, ``_target``, ``_copies`` (how often the mix takes it).

    A source whose target is k.f times its size gives every document k times, and once more the documents below its threshold. Null
    and empty texts have size 0 and follow their hash; a null source is a source; of equal rows (identifier and text) some may be taken and
    others not. The mix depends on identifiers, texts and sources only, so reruns agree. An empty table gives an empty result.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n"))
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    digest = F.md5(F.encode(F.concat(blank(id_col), F.lit(":"), blank(text_col)), "UTF-8"))
    narrow = cut(
        docs.select(
            F.col(f"`{id_col}`").alias("_id"),
            F.col(f"`{source_col}`").cast("string").alias("_source"),
            key.alias("_key"),
            words(F.col(f"`{text_col}`")).alias("_size"),
            F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("bigint").alias("_hash"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    sizes = narrow.groupBy("_key", "_source").agg(F.sum("_size").alias("_source_size"))
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0)).cast("bigint")
    goals = cut(targets(sizes, weights, most).withColumn("_whole", whole).withColumn("_budget", F.col("_target") - F.col("_whole") * F.col("_source_size")))
    chosen = within_budget(narrow, thresholds(narrow.select("_key", "_hash", "_size"), goals))
    return (
        chosen.join(goals.select("_key", "_source_size", "_target", "_whole"), "_key")
        .withColumn("_copies", F.col("_whole") + F.col("_in").cast("bigint"))
        .select("_id", "_size", "_source_size", "_target", "_copies")
    )
