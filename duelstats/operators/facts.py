"""Daily facts: what the boards count, summed once per day, deck and facet, from which every board is added up.

A bout is read once and explodes into a few (kind, name) items per side; the map side adds them up at once. Facts of parts of
the bouts add up to the facts of all, and facts of days to those of a window, so they can be stored and merged: deck, card and
archetype counts, facets, trends, matchup cells and totals need nothing else. Only the latest samples are read apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelstats.functions import outcomes, ranks
from duelstats.functions.text import sample_date, strip
from duelstats.operators import matchups
from duelstats.operators.boards import added, iso_date
from duelstats.operators.samples import board_scopes, played_date, regular_mode
from duelstats.operators.stats import COUNTS, result_counts
from duelstats.params import JobConfig

DAY = ["version", "day", "mode"]
KEYS = [*DAY, "order_class", "deck_fingerprint", "kind", "name"]
SCHEMA = ", ".join([*[f"{k} string" for k in KEYS], *[f"{c} bigint" for c in COUNTS]])
FACETS = ("player", "weapon", "style", "soul")


def daily(bouts: DataFrame, *keys: str, every_day: bool = True) -> DataFrame:
    """Facts of the bouts: ``KEYS`` and counts, by further ``keys`` of the bouts if named.

    Kinds: ``deck`` counts a side's deck, the ``FACETS`` its named traits, ``versus`` the deck it met (``name``), and ``match`` the
    matches by the classes of their counted sides. Without ``every_day`` only ``deck`` facts keep their day, for use within
    one window.
    """
    filled = lambda s: F.coalesce(s["deck_fingerprint"], F.lit("")) != ""
    text = lambda c: F.coalesce(c, F.lit(""))
    usable = F.filter("sides", filled)
    counted = F.filter("sides", lambda s: filled(s) & s["side_index"].isin(1, 2))
    classes = F.array_join(F.array_sort(F.array_distinct(F.transform("counted", lambda s: ranks.order_class(s["rank_order"])))), "+")
    seen = bouts.select(
        *keys, text(F.col("version")).alias("version"), played_date(text(F.col("played_at"))).alias("day"), text(F.col("mode")).alias("mode"),
        F.col("result").alias("match_result"), usable.alias("usable"), counted.alias("counted"),
    ).where(F.size("counted") > 0)
    one, two = F.get("usable", F.lit(0)), F.get("usable", F.lit(1))
    apart = (F.size("usable") == 2) & (one["side_index"] != two["side_index"]) & (one["deck_fingerprint"] != two["deck_fingerprint"])
    sides = seen.select(*keys, *DAY, "match_result", F.when(apart, F.col("usable")).alias("met"), classes.alias("classes"), F.posexplode("counted").alias("place", "me"))
    me = F.col("me")
    other = F.filter("met", lambda s: s["side_index"] != me["side_index"])

    def item(kind: str, name: Column, deck: Column | None = None, cls: Column | None = None) -> Column:
        own = me["deck_fingerprint"] if deck is None else deck
        return F.struct(F.lit(kind).alias("kind"), text(name).alias("name"), own.alias("deck_fingerprint"), (F.col("order_class") if cls is None else cls).alias("order_class"))

    rows = sides.withColumns({"order_class": ranks.order_class(me["rank_order"]), "result": outcomes.board_result(F.col("match_result"), me["side_index"], me["result"])})
    named = F.array(
        item("player", strip(text(me["player_name"]))), item("weapon", me["weapon"]), item("style", me["style"]), item("versus", F.get(other, F.lit(0))["deck_fingerprint"]),
        item("match", F.when(F.col("place") == 0, F.col("classes")), F.lit(""), F.lit("")),
    )
    souls = F.transform(F.coalesce(me["souls"], F.array().cast("array<string>")), lambda s: item("soul", s))
    items = F.concat(F.array(item("deck", F.lit(""))), F.filter(F.concat(named, souls), lambda i: i["name"] != ""))
    exploded = rows.select(*keys, *DAY, "result", F.explode(items).alias("i")).select(*keys, *DAY, "result", "i.*")
    if not every_day:
        exploded = exploded.withColumn("day", F.when(F.col("kind") == "deck", F.col("day")).otherwise(""))
    return exploded.groupBy(*keys, *KEYS).agg(*result_counts(F.col("result"))).select(*KEYS, *COUNTS, *keys)


def changed(facts: DataFrame, more: DataFrame, less: DataFrame | None, *keys: str) -> DataFrame:
    """Facts after those of some bouts have come and those of others have gone, as ``daily`` has them of the bouts that are left."""
    parts = facts.select(*KEYS, *COUNTS, *keys).unionByName(more)
    if less is not None:
        parts = parts.unionByName(less.withColumns({c: -F.col(c) for c in COUNTS}))
    return parts.groupBy(*keys, *KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS]).where("sample_count > 0").select(*KEYS, *COUNTS, *keys)


def within(facts: DataFrame, cfg: JobConfig) -> DataFrame:
    """Facts of the window, modes and version of ``cfg``, as ``samples.in_scope`` takes bouts."""
    kept = facts.where((F.col("day") != "") & F.col("day").between(cfg.date_from, cfg.date_to) & regular_mode(F.col("mode"), cfg))
    return kept.where(F.col("version") == cfg.version) if cfg.version else kept


def _summed(facts: DataFrame, kinds: tuple[str, ...], *by: str) -> DataFrame:
    """Counts of some kinds per class and ``by``, then per rank scope."""
    sums = facts.where(F.col("kind").isin(*kinds)).groupBy("order_class", *by).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return added(board_scopes(sums), "rank_scope", *by)


def deck_counts(facts: DataFrame, *keys: str) -> DataFrame:
    """``boards.deck_counts``, by further keys if named."""
    return _summed(facts, ("deck",), *keys, "deck_fingerprint")


def facets(facts: DataFrame, anchor: str = "") -> DataFrame:
    """``boards.facets``; the dates are the days of the decks' own counts."""
    named = _summed(facts, FACETS, "deck_fingerprint", "kind", "name")
    date = sample_date(F.col("day"))
    if iso_date(anchor):
        date = F.when(F.date_diff(F.to_date(F.lit(anchor)), date).between(0, 13), date)
    dated = facts.where(F.col("kind") == "deck").withColumns({"kind": F.lit("date"), "name": F.date_format(date, "yyyy-MM-dd")}).where("name IS NOT NULL")
    return named.unionByName(_summed(dated, ("date",), "deck_fingerprint", "kind", "name"))


def cells(facts: DataFrame) -> DataFrame:
    """``matchups.cells`` without the pairs."""
    counted = _summed(facts, ("versus",), "deck_fingerprint", "name")
    return matchups.toned(counted.withColumnsRenamed({"deck_fingerprint": "row_fingerprint", "name": "column_fingerprint"}))


def scope_totals(facts: DataFrame) -> DataFrame:
    """``boards.scope_totals``: a match counts once in every scope that one of its sides is in."""
    scopes = F.array_distinct(F.flatten(F.transform(F.split("name", "\\+"), ranks.scopes_of_order_class)))
    matches = facts.where("kind = 'match'").groupBy("name").agg(F.sum("sample_count").alias("m")).select(F.explode(scopes).alias("rank_scope"), "m", F.lit(0).alias("s"))
    sides = deck_counts(facts).select("rank_scope", F.lit(0).alias("m"), F.col("sample_count").alias("s"))
    return matches.unionByName(sides).groupBy("rank_scope").agg(F.sum("m").alias("match_count"), F.sum("s").alias("side_sample_count"))
