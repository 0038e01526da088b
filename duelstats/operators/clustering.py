"""Archetypes: greedy leader clustering of decks by the cost of the cards they share.

Rule: decks come in board order; a deck joins the first leader it shares at least ``threshold`` cost with, else it
becomes a leader itself. Only leaders attract, so clusters do not chain.

Decks of any width go one way. Only the costed cards of a deck count, so decks with the same ones are one *set*, placed
where its first deck stands. Sets are looked up by an inverted index over weighted prefixes: with the cards of a set in one
common order, rare ones first, two sets that share enough cost share a card before the point where the rest falls
below the threshold, so common cards seldom have to be looked up.

The sequential rule is the lexicographically first maximal independent set of the similarity graph. It is found in
blocks of growing length in board order (Blelloch, Fineman, Shun: "Greedy sequential maximal independent set and
matching are parallel on average", SPAA 2012): what is left after the leaders so far took theirs is sparse, so only
few sets of a block are similar. Within a block a set without an earlier open neighbour is a leader, in rounds; then
the new leaders take theirs among all sets behind the block, and the pairs are never written, only the first leader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelstats.functions import decks, outcomes
from duelstats.operators.ranking import ranked, top
from duelstats.params import CORE_LIMIT, MEMBER_LIMIT, SIMILAR_COST
from duelstats.session import cut

BLOCK = 512  # sets of a board in the first block; the next ones are GROWTH times as long
GROWTH = 4
BLOCK_MOST = 1 << 15


def shared_cost(left: Column, right: Column, costs: Column) -> Column:
    """Cost shared by two card arrays; ``costs`` is a map from card to cost."""
    both = F.array_intersect(left, right)
    return F.aggregate(both, F.lit(0.0), lambda total, card: total + F.coalesce(costs[card], F.lit(0.0)))


def costed_cards(ranked_decks: DataFrame, card_dim: DataFrame, board: str) -> DataFrame:
    """Per deck its distinct cards of positive cost, dearest first."""
    cards = ranked_decks.select(board, "rank", F.explode(decks.distinct_cards(decks.cards_of(F.col("deck_fingerprint")))).alias("card_hash"))
    priced = cards.join(card_dim.select("card_hash", "cost"), "card_hash").where(F.col("cost") > 0)
    falling = F.sort_array(F.collect_list(F.struct((-F.col("cost")).alias("minus"), F.col("card_hash").alias("card"))))
    return priced.groupBy(board, "rank").agg(falling.alias("cards"))


def card_sets(ranked_decks: DataFrame, card_dim: DataFrame, threshold: float, board: str) -> tuple[DataFrame, DataFrame]:
    """Decks (board, rank, first) whose costed cards reach the threshold, and their sets (board, first, cards, costs, prefix).

    ``first`` is the smallest rank with the same cards. ``cards`` are in the order of the index, ``prefix`` are those that
    a similar set may share first. A deck below the threshold is similar to none, not even to its equals.
    """
    priced = costed_cards(ranked_decks, card_dim, board)
    cost = F.aggregate("cards", F.lit(0.0), lambda total, c: total - c["minus"])
    priced = cut(priced.where(cost >= threshold).withColumn("key", F.array_join("cards.card", ",")))
    firsts = priced.groupBy(board, "key").agg(F.min("rank").alias("first"), F.any_value("cards").alias("cards"))
    firsts = cut(firsts)
    singles = firsts.select(board, "first", F.explode("cards").alias("c")).select(board, "first", F.col("c.card").alias("card"), (-F.col("c.minus")).alias("cost"))
    common = singles.groupBy(board, "card").agg(F.count(F.lit(1)).alias("often"))
    rare_first = F.sort_array(F.collect_list(F.struct("often", "card", "cost")))
    sets = singles.join(common, [board, "card"]).groupBy(board, "first").agg(rare_first.alias("c"))
    # cost from each card to the end, by what stands before it; a little more for the rounding of sums
    total = F.aggregate("c.cost", F.lit(0.0), lambda t, x: t + x)
    before = lambda i: F.aggregate(F.slice("c.cost", 1, i), F.lit(0.0), lambda t, x: t + x)
    prefix = F.filter("c.card", lambda _, i: F.col("total") - before(i) >= threshold - 1e-9)
    sets = sets.withColumn("total", total).select(board, "first", F.col("c.card").alias("cards"), F.col("c.cost").alias("costs"), prefix.alias("prefix"))
    numbered = priced.select(board, "rank", "key").join(firsts.select(board, "key", "first"), [board, "key"])
    return numbered.select(board, "rank", "first"), cut(sets)


def _similar(index: DataFrame, probe: DataFrame, threshold: float, board: str) -> DataFrame:
    """(board, first, near): sets of ``index`` that the sets of ``probe`` share enough cost with, found once per shared prefix card."""
    left = index.select(board, F.col("first").alias("near"), F.col("cards").alias("near_cards"), F.map_from_arrays("cards", "costs").alias("cost"), F.explode("prefix").alias("card"))
    right = probe.select(board, "first", "cards", F.explode("prefix").alias("card"))
    met = left.join(right, [board, "card"]).where(F.col("near") < F.col("first"))
    return met.where(shared_cost(F.col("near_cards"), F.col("cards"), F.col("cost")) >= threshold).select(board, "first", "near")


def _heads(nodes: DataFrame, edges: DataFrame, board: str) -> DataFrame:
    """Nodes (board, first) that the sequential rule makes leaders, among ``edges`` (board, first, near) to earlier nodes."""
    open_, heads = nodes, None
    while True:
        new = cut(open_.join(edges.select(board, "first").distinct(), [board, "first"], "left_anti"))
        heads = new if heads is None else heads.unionByName(new)
        if edges.isEmpty():
            return heads
        near = new.withColumnRenamed("first", "near")
        taken = cut(edges.join(near, [board, "near"], "left_semi").select(board, "first").distinct())
        decided = new.unionByName(taken)
        open_ = open_.join(decided, [board, "first"], "left_anti")
        # taken nodes attract nobody, so their edges go at both ends
        edges = cut(
            edges.join(taken, [board, "first"], "left_anti").join(decided.withColumnRenamed("first", "near"), [board, "near"], "left_anti")
        )


def leaders(ranked_decks: DataFrame, card_dim: DataFrame, threshold: float = SIMILAR_COST, board: str = "rank_scope") -> DataFrame:
    """Map every deck to the rank of its leader: (board, rank, leader).

    ``ranked_decks`` has (board, rank, deck_fingerprint); boards are clustered side by side.
    """
    numbered, undecided = card_sets(ranked_decks, card_dim, threshold, board)
    found, size = undecided.select(board, "first", F.col("first").alias("leader")).limit(0), BLOCK
    while not undecided.isEmpty():
        block = cut(top(undecided, [board], [F.col("first").asc()], size, "place").drop("place"))
        edges = cut(_similar(block, block, threshold, board).distinct())
        heads = _heads(block.select(board, "first"), edges, board)
        own = heads.withColumn("leader", F.col("first"))
        inside = edges.join(heads.withColumnRenamed("first", "near"), [board, "near"]).groupBy(board, "first").agg(F.min("near").alias("leader"))
        rest = undecided.join(block.select(board, "first"), [board, "first"], "left_anti")
        behind = _similar(block.join(heads, [board, "first"], "left_semi"), rest, threshold, board).groupBy(board, "first").agg(F.min("near").alias("leader"))
        behind = cut(behind)
        found = found.unionByName(own).unionByName(inside).unionByName(behind)
        undecided = cut(rest.join(behind, [board, "first"], "left_anti"))
        size = min(GROWTH * size, BLOCK_MOST)
    joined = numbered.join(found, [board, "first"]).select(board, "rank", "leader")
    own = ranked_decks.select(board, "rank").join(joined, [board, "rank"], "left")
    return own.withColumn("leader", F.coalesce("leader", "rank"))


def memberships(ranked_decks: DataFrame, card_dim: DataFrame, threshold: float = SIMILAR_COST, board: str = "rank_scope") -> DataFrame:
    """(board, deck_fingerprint, rank, leader, representative)."""
    assigned = leaders(ranked_decks, card_dim, threshold, board)
    names = ranked_decks.select(board, "rank", "deck_fingerprint")
    heads = names.select(board, F.col("rank").alias("leader"), F.col("deck_fingerprint").alias("representative"))
    return assigned.join(names, [board, "rank"]).join(heads, [board, "leader"])


def core_cards(members: DataFrame, card_dim: DataFrame, threshold: float = SIMILAR_COST, board: str = "rank_scope") -> DataFrame:
    """Cards that make up a cluster: by samples over all occurrences, then cost, then first sight, until their cost
    reaches the threshold or five are named.

    ``members`` carry (board, representative, rank, deck_fingerprint, sample_count).
    """
    keys = [board, "representative"]
    placed = members.select(*keys, "rank", "sample_count", F.posexplode(decks.cards_of(F.col("deck_fingerprint"))).alias("pos", "card_hash"))
    weights = placed.groupBy(*keys, "card_hash").agg(F.sum("sample_count").alias("weight"), F.min(F.struct("rank", "pos")).alias("seen"))
    priced = weights.join(card_dim.select("card_hash", "cost"), "card_hash", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    order = [F.col("weight").desc(), F.col("cost").desc(), F.col("seen").asc()]
    first = top(priced, keys, order, CORE_LIMIT, "place")
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "card_hash", "cost", "weight"))).alias("cards"))
    spent = lambda place: F.aggregate(
        F.filter("cards", lambda c: c["place"] < place), F.lit(0.0), lambda total, c: total + c["cost"]
    )
    kept = listed.select(*keys, F.explode("cards").alias("c"), "cards").where(spent(F.col("c.place")) < threshold)
    return kept.select(*keys, "c.place", "c.card_hash", "c.cost", "c.weight")


def analysis_archetypes(base: DataFrame, card_dim: DataFrame, threshold: float = SIMILAR_COST) -> tuple[DataFrame, DataFrame]:
    """Clusters of the floor-filtered base statistics, in the order of the analysis reports.

    Returns the members with their statistics and one summary row per cluster.
    """
    order = [F.coalesce("wilson_lower_bound", F.lit(0.0)).desc(), F.col("sample_count").desc(), F.col("deck_fingerprint").asc()]
    one = base.withColumn("board", F.lit("report"))
    numbered = cut(ranked(one, ["board"], order))
    members = cut(memberships(numbered, card_dim, threshold, "board").join(numbered.drop("deck_fingerprint"), ["board", "rank"]))
    return members, rollup(members, "board", "representative")


def rollup(members: DataFrame, *keys: str) -> DataFrame:
    """Sums over member statistics; the mean difference weighs members by their samples, blanks left out."""
    counts = ["sample_count", "win_count", "loss_count", "draw_count", "castle_crash_count", "castle_crashed_count"]
    diff = F.col("avg_castle_diff")
    summed = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("member_count"),
        *[F.sum(c).alias(c) for c in counts],
        F.try_divide(F.sum(diff * F.col("sample_count")), F.sum(F.when(diff.isNotNull(), F.col("sample_count")))).alias("avg_castle_diff"),
    )
    wins, losses = F.col("win_count"), F.col("loss_count")
    return summed.select("*", outcomes.win_rate(wins, losses).alias("win_rate"), outcomes.wilson(wins, losses).alias("wilson_lower_bound"))


def first_members(members: DataFrame, board: str = "rank_scope", limit: int = MEMBER_LIMIT) -> DataFrame:
    return top(members, [board, "representative"], [F.col("rank").asc()], limit, "place")


def first_similar(ranked_decks: DataFrame, card_dim: DataFrame, threshold: float = SIMILAR_COST, board: str = "rank_scope") -> DataFrame:
    """Earliest similar deck of every deck that has an earlier one: (board, rank, first_similar).

    The similarity join without its pairs: blocks of sets in board order are looked up by all sets that have found none
    yet, and a set that has found one is not asked again.
    """
    numbered, sets = card_sets(ranked_decks, card_dim, threshold, board)
    undecided, ahead, size = sets, sets, BLOCK
    found = sets.select(board, "first", F.col("first").alias("near")).limit(0)
    while not undecided.isEmpty() and not ahead.isEmpty():
        block = cut(top(ahead, [board], [F.col("first").asc()], size, "place").drop("place"))
        near = cut(_similar(block, undecided, threshold, board).groupBy(board, "first").agg(F.min("near").alias("near")))
        found = found.unionByName(near)
        undecided = cut(undecided.join(near, [board, "first"], "left_anti"))
        ahead = cut(ahead.join(block.select(board, "first"), [board, "first"], "left_anti"))
        size = min(GROWTH * size, BLOCK_MOST)
    nearest = numbered.join(found, [board, "first"], "left").select(board, "rank", F.coalesce("near", "first").alias("first_similar"))
    return nearest.where(F.col("first_similar") < F.col("rank"))
