"""Decks as multisets of cards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN_CARD = "未识别卡"


def named_cards(cards: Column) -> Column:
    return F.filter(cards, lambda c: c.isNotNull() & (c != ""))


def fingerprint(cards: Column) -> Column:
    """Sorted multiset as one text; copies of a card stay."""
    return F.array_join(F.sort_array(named_cards(cards)), ",")


def distinct_cards(cards: Column) -> Column:
    return F.array_distinct(named_cards(cards))


def cards_of(fp: Column) -> Column:
    return named_cards(F.split(fp, ","))


def unknown_label(card: Column) -> Column:
    return F.concat(F.lit(UNKNOWN_CARD + "("), F.substring(card, 1, 8), F.lit(")"))


def card_label(name: Column, code: Column, card: Column, cost_label: Column, unit_type: Column) -> Column:
    """``name(cost unit)`` with whatever of the two is known."""
    base = F.coalesce(F.nullif(name, F.lit("")), F.nullif(code, F.lit("")), card)
    suffix = F.concat_ws(" ", F.nullif(cost_label, F.lit("")), F.nullif(unit_type, F.lit("")))
    return F.when(suffix == "", base).otherwise(F.concat(base, F.lit("("), suffix, F.lit(")")))


def card_cost(*texts: Column) -> Column:
    """First text that is a number, else 0."""
    return F.coalesce(*[F.trim(t).try_cast("double") for t in texts], F.lit(0.0))


def looks_like_code(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) > 0) & (F.length(t) <= 8) & t.rlike(r"[\p{L}]|[^\x00-\x7F]") & t.rlike(r"(?U)\d")


def archetype_id(representative: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("archetype:"), representative), 256), 1, 16)


def archetype_title(labels: Column) -> Column:
    names = F.transform(F.slice(labels, 1, 3), lambda x: F.substring_index(x, "(", 1))
    names = F.filter(names, lambda x: x != "")
    return F.when(F.size(names) > 0, F.concat(F.array_join(names, " / "), F.lit(" 系"))).otherwise("未识别卡组分类")
