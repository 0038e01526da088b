"""Identifiers and what URLs carry. Site addresses are parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def query_value(url: Column, key: str) -> Column:
    """First value of a query parameter, '' when absent."""
    return F.coalesce(F.url_decode(F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{key}=([^&#]*)", 1)), F.lit(""))


def replay_id(url: Column) -> Column:
    by_query = query_value(url, "p")
    by_path = F.regexp_extract(F.coalesce(url, F.lit("")), r"/live/([A-Za-z0-9]+)/master\.m3u8", 1)
    return F.when(by_query != "", by_query).otherwise(by_path)


def detail_t(url: Column) -> Column:
    return query_value(url, "t")


def follow_id(url: Column) -> Column:
    return query_value(url, "f")


def host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://([^/?#]+)", 1)


def absolute_url(href: Column, base: Column) -> Column:
    """Join a link with the address of its page: absolute, host-relative or folder-relative."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^(https?://[^/]+.*/)[^/]*$", "$1")
    folder = F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder)
    return (
        F.when(F.coalesce(href, F.lit("")) == "", "")
        .when(href.rlike("^https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(F.concat(folder, href))
    )


def stream_url(replay: Column, template: str) -> Column:
    """``template`` holds ``{id}`` where the replay id goes."""
    head, tail = template.split("{id}")
    return F.when(F.coalesce(replay, F.lit("")) == "", "").otherwise(F.concat(F.lit(head), replay, F.lit(tail)))


def played_at_of(t: Column) -> Column:
    """Unix seconds as Japan wall-clock text, '' when the text is no integer. Wants a UTC session."""
    seconds = F.trim(F.coalesce(t, F.lit(""))).try_cast("bigint")
    text = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), "Asia/Tokyo"), "yyyy-MM-dd HH:mm")
    return F.coalesce(text, F.lit(""))


def public_id(replay: Column, follow: Column, t: Column) -> Column:
    replay, follow, t = (F.coalesce(c, F.lit("")) for c in (replay, follow, t))
    return (
        F.when(replay != "", F.concat(F.lit("r:"), replay))
        .when((follow != "") & (t != ""), F.concat(F.lit("d:"), follow, F.lit(":"), t))
        .otherwise(F.concat(F.lit("d:unknown:"), F.substring(F.sha2(F.concat(follow, F.lit("|"), t), 256), 1, 16)))
    )
