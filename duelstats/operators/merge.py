"""Entity resolution of sightings and the field rules that merge them into one match.

Every rule is an aggregate over arrival order (``seq``, any orderable value), so an often-sighted match combines on
the map side instead of being listed anywhere. A match's *state* keeps the winner of every rule with its place in that
order, so states of parts of the sightings, in whatever order they come, add up to the state of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelstats.functions import decks, links, loadout, ranks
from duelstats.functions.markup import let
from duelstats.functions.text import coerce_number
from duelstats.operators.components import components
from duelstats.schemas import PLAYER

DETAIL_PAGE = "/members/history/detail"


def filled(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""


def with_aliases(sightings: DataFrame) -> DataFrame:
    """Names a sighting goes by: its replay, and the player and second of its detail page."""
    url = F.col("detail_url")
    follow = F.when(filled("follow_id"), F.col("follow_id")).otherwise(links.follow_id(url))
    second = F.when(filled("detail_t"), F.col("detail_t")).otherwise(links.detail_t(url))
    named = sightings.withColumns({"follow_id": follow, "detail_t": second})
    by_detail = filled("follow_id") & filled("detail_t")
    return named.withColumns(
        {
            "replay_alias": F.when(filled("replay_id"), F.concat(F.lit("r:"), "replay_id")),
            "detail_alias": F.when(by_detail, F.concat(F.lit("d:"), "follow_id", F.lit(":"), "detail_t")),
        }
    )


def resolve(sightings: DataFrame) -> DataFrame:
    """Add ``entity``: sightings that share an alias, directly or through others, are one match.

    A sighting without any alias stays alone under the hash of its content.
    """
    named = named_alone(sightings)
    both = named.where(F.col("replay_alias").isNotNull() & F.col("detail_alias").isNotNull())
    labels = components(both.select(F.col("replay_alias").alias("a"), F.col("detail_alias").alias("b")))
    return labelled(named, labels.select(F.col("node").alias("alias"), F.col("component").alias("entity")))


def named_alone(sightings: DataFrame, *apart: str) -> DataFrame:
    """``with_aliases`` and the name that a sighting without aliases goes by: its content but for the columns ``apart``."""
    content = F.to_json(F.struct(*[c for c in sightings.columns if c not in ("seq", *apart)]))
    return with_aliases(sightings.withColumn("alone", F.concat(F.lit("x:"), F.sha2(content, 256))))


def labelled(named: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``entity`` by the labels (alias, entity) of aliases; an alias without label is its own."""
    key = F.coalesce("replay_alias", "detail_alias")
    joined = named.withColumn("_alias", key).join(labels.select(F.col("alias").alias("_alias"), F.col("entity").alias("_label")), "_alias", "left")
    return joined.withColumn("entity", F.coalesce("_label", "_alias", "alone")).drop("_label", "_alias", "alone")


def aliases(resolved: DataFrame) -> DataFrame:
    kinds = F.array(
        F.struct(F.col("replay_alias").alias("alias"), F.lit("replay").alias("alias_type")),
        F.struct(F.col("detail_alias").alias("alias"), F.lit("detail").alias("alias_type")),
    )
    rows = resolved.select("entity", F.explode(kinds).alias("a")).select("entity", "a.*")
    return rows.where(F.col("alias").isNotNull()).distinct()


def last_where(value: Column, test: Column) -> Column:
    return F.max_by(value, F.when(test, F.col("seq")))


def last_filled(value: Column) -> Column:
    return last_where(value, filled(value))


def _rules(stream_template: str, detail_page: str) -> list[tuple[str, bool, Column, Column]]:
    """(name, whether the last one wins, value, test) of every rule that a state keeps a winner of."""
    col, light = F.col, F.col("light")
    full = ~light
    told = F.coalesce(F.nullif(links.played_at_of(col("detail_t")), F.lit("")), col("played_at"))
    stream = F.when(filled("m3u8_url"), col("m3u8_url")).otherwise(links.stream_url(col("replay_id"), stream_template))
    source = F.when(filled("source_url"), col("source_url")).otherwise(col("detail_url"))
    detailed = (F.size("castle_rows") > 0) | ~F.coalesce(col("timeline_data"), F.lit("{}")).isin("", "{}", "null")
    people = F.struct("players", "result", "light")
    summary = F.struct("title", "detail_error", "castle_title", "castle_rows", "timeline_labels", "timeline_data")
    is_page = F.coalesce(col("detail_url"), F.lit("")).contains(detail_page)
    has_url = filled("detail_url")
    other_url = F.when(filled("play_url"), col("play_url")).otherwise(col("source_url"))
    last, first = True, False
    return [
        *[(c, last, col(c), filled(c)) for c in ("replay_id", "detail_t", "follow_id", "mode", "version", "play_url")],
        ("m3u8_url", last, stream, filled(stream)),
        ("result", last, col("result"), filled("result") & (col("result") != "unknown")),
        ("played_at", last, told, full & filled(told)),
        ("played_at_light", first, told, light & filled(told)),
        ("source_url", last, source, full & filled(source)),
        ("source_url_light", first, source, light & filled(source)),
        ("address", last, col("detail_url"), full & has_url),
        ("address_page", first, col("detail_url"), light & is_page),
        ("address_light", last, col("detail_url"), light & has_url),
        # without any, the address under which the match was first seen
        ("address_other", first, other_url, filled(other_url)),
        ("people", last, people, full),
        ("people_light", first, people, light & (F.size("players") > 0)),
        ("summary", last, summary, full | detailed),
        ("summary_light", first, summary, light),
    ]


def states(resolved: DataFrame, stream_template: str = "{id}", detail_page: str = DETAIL_PAGE) -> DataFrame:
    """One row per entity: (entity, winners, sightings); a winner is a (seq, value)."""

    def winner(name: str, last: bool, value: Column, test: Column) -> Column:
        entry, place = F.struct(F.col("seq").alias("seq"), value.alias("value")), F.when(test, F.col("seq"))
        return (F.max_by(entry, place) if last else F.min_by(entry, place)).alias(name)

    return resolved.groupBy("entity").agg(*[winner(*rule) for rule in _rules(stream_template, detail_page)], F.count(F.lit(1)).alias("sightings"))


def combined(parts: DataFrame) -> DataFrame:
    """States of the same entities added up; the mark ``fresh``, if they have it, holds where one of the parts does."""
    winners = [(name, F.max_by if last else F.min_by) for name, last, *_ in _rules("{id}", DETAIL_PAGE)]
    return parts.groupBy("entity").agg(*[by(F.col(n), F.col(f"{n}.seq")).alias(n) for n, by in winners], F.sum("sightings").alias("sightings"), *[F.max(c).alias(c) for c in parts.columns if c == "fresh"])


def finished(state: DataFrame) -> DataFrame:
    """Matches out of their states, one row per entity.

    Full sources: the last non-empty value of each field wins, the last record brings sides and decks, even if it has none,
    and the summary. Light sources (replay search) fill gaps only: their sides and decks count where no full source told of the
    match, their summary also if it carries castle rows or a timeline. A replay id once known stays. Without full sources
    the address of a detail page is preferred over other addresses.
    """
    won = lambda *names: F.coalesce(*[F.col(f"{n}.value") for n in names])
    out = state.select(
        "entity",
        *[won(c).alias(c) for c in ("replay_id", "detail_t")],
        won("follow_id").alias("primary_follow_id"),
        won("played_at", "played_at_light").alias("played_at"),
        *[won(c).alias(c) for c in ("mode", "version")],
        F.coalesce(won("result"), F.lit("unknown")).alias("result"),
        won("address", "address_page", "address_light", "address_other").alias("detail_url"),
        *[won(c).alias(c) for c in ("play_url", "m3u8_url")],
        won("source_url", "source_url_light").alias("source_url"),
        won("people", "people_light").alias("_people"),
        won("summary", "summary_light").alias("_summary"),
        "sightings",
        *[c for c in state.columns if c == "bucket"],
    )
    public = links.public_id(F.col("replay_id"), F.col("primary_follow_id"), F.col("detail_t"))
    nameless = ~filled("replay_id") & ~(filled("primary_follow_id") & filled("detail_t"))
    return out.select(
        "entity",
        F.when(nameless, F.concat(F.lit("d:unknown:"), F.substring(F.sha2(F.col("entity"), 256), 1, 16))).otherwise(public).alias("public_id"),
        F.when(filled("replay_id"), "replay").otherwise("detail_only").alias("id_state"),
        *[c for c in out.columns if c not in ("entity", "_people", "_summary")],
        F.col("_people.players").alias("players"),
        "_summary.*",
    )


def merged(resolved: DataFrame, stream_template: str = "{id}", detail_page: str = DETAIL_PAGE) -> DataFrame:
    """One row per entity out of its sightings (see ``finished``)."""
    return finished(states(resolved, stream_template, detail_page))


def typed_sides(matches: DataFrame) -> DataFrame:
    """Merged matches as bouts: the pockets of every side become typed columns, its card list becomes its deck."""

    def side(p: Column, i: Column) -> Column:
        pockets = F.struct(F.try_parse_json(p["profile"]).alias("profile"), F.try_parse_json(p["selected"]).alias("selected"))
        return let(pockets, lambda v: typed(p, i, v["profile"], v["selected"]))

    def typed(p: Column, i: Column, profile: Column, selected: Column) -> Column:
        stat = lambda key: F.coalesce(
            coerce_number(profile, f"$.battle_stats.{key}.total"), coerce_number(profile, f"$.battle_stats.{key}")
        )
        text = lambda name, default="": F.coalesce(p[name], F.lit(default)).alias(name)
        own_result = F.coalesce(F.nullif(p["result"], F.lit("")), F.when(p["role"] == "player", F.col("result")), F.lit("unknown"))
        return F.struct(
            F.coalesce(p["side_index"], i + 1).cast("int").alias("side_index"),
            text("role", "unknown"),
            text("player_name"),
            text("follow_id"),
            own_result.alias("result"),
            text("castle_rate"),
            ranks.ranking(profile).alias("rank"),
            ranks.rank_order(profile).alias("rank_order"),
            stat("kill_count").alias("kill_count"),
            stat("death_count").alias("death_count"),
            loadout.selected_name(selected, "weapon").alias("weapon"),
            loadout.selected_name(selected, "school").alias("style"),
            F.get("_souls", i).alias("souls"),
            decks.named_cards(p["deck_ids"]).alias("cards"),
            decks.fingerprint(p["deck_ids"]).alias("deck_fingerprint"),
        )

    pockets = F.coalesce(F.transform("players", lambda p: p["selected"]), F.array().cast("array<string>"))
    opened = matches.withColumn("_souls", loadout.soul_names(pockets))
    sides = F.array_sort(F.transform("players", side), lambda a, b: a["side_index"] - b["side_index"])
    return opened.withColumn("sides", sides).drop("players", "_souls").withColumn("match_id", F.col("public_id"))


def last_per_key(rows: DataFrame, *keys: str) -> DataFrame:
    """Keep the latest row per key (by ``seq``)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")


def first_per_key(rows: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")


def players(rows: DataFrame) -> DataFrame:
    """Player dimension: last non-empty name, state and address per follow id."""
    return rows.groupBy("follow_id").agg(
        F.coalesce(last_filled(F.col("name")), F.concat(F.lit("f-"), F.first("follow_id"))).alias("name"),
        F.coalesce(last_filled(F.col("state")), F.lit("")).alias("state"),
        F.coalesce(last_filled(F.col("daily_url")), F.lit("")).alias("daily_url"),
        F.max("seq").alias("last_seen"),
    )


def new_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads whose content the same user has not sent before; first of its kind within the batch."""
    return first_per_key(uploads, "user_id", "content_hash").join(known.select("user_id", "content_hash"), ["user_id", "content_hash"], "left_anti")


def complete_detail() -> Column:
    """Whether a merged match is told in full: version, result, sides that all have decks, some rate and some profile."""
    players = F.coalesce("players", F.array().cast(f"array<{PLAYER}>"))
    return (
        filled("version")
        & ~F.coalesce("result", F.lit("unknown")).isin("", "unknown")
        & (F.size(players) > 0)
        & F.forall(players, lambda p: F.exists(F.coalesce(p["deck_ids"], F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != ""))
        & F.exists(players, lambda p: F.coalesce(p["castle_rate"], F.lit("")) != "")
        & F.exists(players, lambda p: ~F.coalesce(p["profile"], F.lit("")).isin("", "{}", "null"))
    )


def lightweight(record_result: Column, castle_rows: Column, timeline: Column) -> Column:
    """A record that tells neither result nor castle nor timeline comes from a light source."""
    no_timeline = F.coalesce(timeline, F.lit("{}")).isin("", "{}", "null")
    return (F.coalesce(F.nullif(record_result, F.lit("")), F.lit("unknown")) == "unknown") & (F.coalesce(F.size(castle_rows), F.lit(0)) <= 0) & no_timeline
