"""Versions: their windows, spans and order."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelstats.params import JobConfig


def windows(starts: DataFrame, open_end: str) -> DataFrame:
    """Window per known version: up to the day before the next start, the last one open to ``open_end``.

    ``starts`` is the known-version table (version, start), a few rows by nature.
    """
    following = F.min("start").over(Window.partitionBy(F.lit(0)).orderBy("start").rangeBetween(1, Window.unboundedFollowing))
    days = starts.select("version", F.to_date("start").alias("day")).withColumn("start", F.unix_date("day"))
    ended = days.withColumn("next", F.date_from_unix_date(following))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    last = F.greatest(text("day"), F.lit(open_end))
    return ended.select("version", text("day").alias("date_from"), F.coalesce(text(F.date_sub("next", 1)), last).alias("date_to"))


def version_at(rows: DataFrame, day: Column, version_windows: DataFrame) -> DataFrame:
    """Add the version in force on a day (ISO text). The windows become one row per day, so the lookup is an equi join."""
    days = F.explode(F.sequence(F.to_date("date_from"), F.to_date("date_to")))
    by_day = version_windows.where(F.col("date_from") <= F.col("date_to")).select(F.col("version").alias("known_version"), days.alias("d"))
    by_day = by_day.select("known_version", F.date_format("d", "yyyy-MM-dd").alias("known_day"))
    return rows.join(by_day, day == F.col("known_day"), "left").drop("known_day")


def uploaded_spans(uploads: DataFrame) -> DataFrame:
    return uploads.groupBy("version").agg(F.min("date_from").alias("date_from"), F.max("date_to").alias("date_to"))


def offered(known: DataFrame, uploads: DataFrame, *current: str) -> DataFrame:
    """All versions a client may ask for: known ones by start, newest first, then the rest by text."""
    names = known.select("version").unionByName(uploads.select(F.trim("version").alias("version")))
    if current:
        names = names.unionByName(known.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in current])).alias("version")))
    listed = names.where(F.coalesce("version", F.lit("")) != "").distinct().join(known.select("version", "start"), "version", "left")
    return listed.orderBy(F.col("start").desc_nulls_last(), F.col("version").desc())


def config_for(version: str, current: JobConfig, stored: JobConfig, known: dict[str, str], span: tuple[str, str] | None, today: date) -> JobConfig:
    """Window of a requested version: the current one, a known one, an uploaded one, the stored one, else an error."""
    if version == current.version:
        return current
    if version in known:
        later = [s for s in known.values() if s > known[version]]
        end = (date.fromisoformat(min(later)) - timedelta(days=1)).isoformat() if later else max(known[version], current.date_to, today.isoformat())
        return replace(current, version=version, date_from=known[version], date_to=end)
    if span is not None and all(span):
        return replace(current, version=version, date_from=span[0], date_to=span[1])
    if version == stored.version:
        return replace(stored, date_to=max(stored.date_from, stored.date_to, today.isoformat()))
    raise ValueError(f"unknown version {version}")
