"""Text and number scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"-?\d+(?:\.\d+)?"
FULL_WIDTH = "０１２３４５６７８９"


def ascii_digits(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, "0123456789")


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_rate(c: Column) -> Column:
    """First decimal number in a text, else null."""
    return F.regexp_extract(ascii_digits(F.coalesce(c, F.lit(""))), NUMBER, 0).try_cast("double")


def coerce_number(variant: Column, path: str) -> Column:
    """Number at a path of a variant: a number as it is, a text through :func:`parse_rate`."""
    return F.coalesce(F.try_variant_get(variant, path, "double"), parse_rate(F.try_variant_get(variant, path, "string")))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Drop private-use glyphs, squeeze white space, drop one trailing ``---``."""
    plain = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x{E000}-\x{F8FF}]", ""))
    return F.trim(F.regexp_replace(plain, r"\s*---$", ""))


def infer_result(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    low = F.lower(text)
    return (
        F.when(low.contains("win") | text.contains("勝利"), "win")
        .when(low.contains("lose") | low.contains("loss") | text.contains("敗北"), "loss")
        .when(low.contains("draw") | text.contains("引き分け") | text.contains("引分"), "draw")
        .otherwise("unknown")
    )


def infer_played_at(c: Column, iso_date: Column) -> Column:
    clock = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{2}:\d{2})", 1)
    return F.when(clock != "", F.concat_ws(" ", iso_date, clock)).otherwise("")


def sample_date(played_at: Column) -> Column:
    """Date of the first ten characters, null unless they are a real ISO date."""
    head = F.substring(played_at, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(head, "yyyy-M-d"))


def year_for_label(label: Column, date_from: str, date_to: str) -> Column:
    """``M/D HH:MM`` has no year: take the first year that puts it inside the window, else ''."""
    pattern = r"(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{2})"
    part = lambda i: F.regexp_extract(label, pattern, i).try_cast("int")
    years = F.array(*[F.lit(y) for y in range(int(date_from[:4]) - 1, int(date_to[:4]) + 2)])
    stamps = F.transform(years, lambda y: F.try_make_timestamp_ntz(y, part(1), part(2), part(3), part(4), F.lit(0)))
    text = F.transform(stamps, lambda t: F.date_format(t, "yyyy-MM-dd HH:mm"))
    inside = F.filter(text, lambda t: t.isNotNull() & F.substring(t, 1, 10).between(date_from, date_to))
    return F.coalesce(F.get(inside, F.lit(0)), F.lit(""))


def version_key(c: Column) -> Column:
    """Numbers inside a version label, for numeric instead of textual order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"))
    numbers = F.transform(found, lambda x: x.try_cast("bigint"))
    return F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(0).cast("bigint")))


def path_component(c: Column) -> Column:
    """Text made safe as one file name part."""
    plain = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[^0-9A-Za-z._-]+", "_")
    plain = F.regexp_replace(plain, "^[._]+|[._]+$", "")
    return F.when(plain == "", "unknown").otherwise(plain)


def package_id(contributor: Column, version: Column, date_from: Column, date_to: Column, body_hash: Column) -> Column:
    return F.concat_ws(":", path_component(contributor), path_component(version), date_from, date_to, F.substring(body_hash, 1, 16))


def percent_text(c: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(F.concat(F.format_string("%.2f", c * 100), F.lit("%")))


def number_text(c: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(F.format_string("%.2f", c))


def points_text(c: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(F.concat(F.format_string("%+.1f", c * 100), F.lit("pt")))
