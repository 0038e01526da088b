"""Deck against deck."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelstats.functions import outcomes, ranks
from duelstats.operators.boards import added, scored
from duelstats.operators.ranking import top
from duelstats.operators.samples import board_scopes
from duelstats.operators.stats import COUNTS, result_counts
from duelstats.params import MATRIX_FLOOR, MATRIX_LIMIT


def pairs(bouts: DataFrame) -> DataFrame:
    """One row per side that meets a different deck. Both sides sit in the bout, so nothing is joined."""
    sides = F.col("sides")
    usable = F.filter(sides, lambda s: F.coalesce(s["deck_fingerprint"], F.lit("")) != "")
    a, b = F.get("usable", F.lit(0)), F.get("usable", F.lit(1))
    met = bouts.select("match_id", F.col("result").alias("match_result"), usable.alias("usable")).where(F.size("usable") == 2)
    met = met.select("match_id", "match_result", a.alias("a"), b.alias("b")).where(
        (F.col("a.deck_fingerprint") != F.col("b.deck_fingerprint")) & (F.col("a.side_index") != F.col("b.side_index"))
    )

    def view(row: Column, column: Column) -> Column:
        return F.struct(
            row["side_index"].alias("side_index"),
            row["deck_fingerprint"].alias("row_fingerprint"),
            column["deck_fingerprint"].alias("column_fingerprint"),
            ranks.order_class(row["rank_order"]).alias("order_class"),
            outcomes.board_result(F.col("match_result"), row["side_index"], row["result"]).alias("result"),
        )

    both = F.array(view(F.col("a"), F.col("b")), view(F.col("b"), F.col("a")))
    return met.select("match_id", F.explode(both).alias("v")).select("match_id", "v.*")


def cells(pair_rows: DataFrame) -> DataFrame:
    """Counts per (rank_scope, row deck, column deck); the scope is the row side's."""
    by_class = pair_rows.groupBy("row_fingerprint", "column_fingerprint", "order_class").agg(*result_counts(F.col("result")))
    return toned(added(board_scopes(by_class), "rank_scope", "row_fingerprint", "column_fingerprint"))


def toned(counted: DataFrame) -> DataFrame:
    """Counted cells with their rate, whether they are shown, and their tone."""
    rate = outcomes.win_rate(F.col("win_count"), F.col("loss_count"))
    seen = (F.col("sample_count") >= MATRIX_FLOOR) & F.col("win_rate").isNotNull()
    return (
        counted.withColumn("win_rate", rate)
        .withColumn("visible", seen)
        .withColumn("tone", F.when(F.col("visible"), outcomes.matchup_tone(F.col("win_rate"))).otherwise("empty"))
    )


def axis(counts: DataFrame, limit: int = MATRIX_LIMIT) -> DataFrame:
    """The decks on the axes of the matrix: best win rate first."""
    order = [
        F.coalesce("win_rate", F.lit(-1.0)).desc(),
        F.col("sample_count").desc(),
        F.coalesce("wilson_lower_bound", F.lit(0.0)).desc(),
        F.col("deck_fingerprint").asc(),
    ]
    return top(scored(counts), ["rank_scope"], order, limit, "matrix_index")


def matrix(axis_rows: DataFrame, cell_rows: DataFrame) -> DataFrame:
    """Every axis deck against every axis deck, the diagonal and unmet pairs empty.

    The axis holds ``MATRIX_LIMIT`` decks per scope, so the grid is bounded; the cells are first cut down to it.
    """
    side = lambda prefix: axis_rows.select(
        "rank_scope", F.col("deck_fingerprint").alias(f"{prefix}_fingerprint"), F.col("matrix_index").alias(f"{prefix}_index")
    )
    rows, columns = F.broadcast(side("row")), F.broadcast(side("column"))
    shown = cell_rows.join(rows, ["rank_scope", "row_fingerprint"]).join(columns, ["rank_scope", "column_fingerprint"])
    values = [*COUNTS, "win_rate", "visible", "tone"]
    grid = side("row").join(side("column"), "rank_scope")
    keys = ["rank_scope", "row_fingerprint", "column_fingerprint", "row_index", "column_index"]
    filled = grid.join(shown.select(*keys, *values), keys, "left")
    return filled.select(
        *keys,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
        "win_rate",
        F.coalesce("visible", F.lit(False)).alias("visible"),
        F.coalesce("tone", F.lit("empty")).alias("tone"),
    )


def matrix_totals(cell_rows: DataFrame) -> DataFrame:
    return cell_rows.groupBy("rank_scope").agg(F.sum("sample_count").alias("sample_count"))
