"""HTML as arrays of elements and strings, so that extraction is Column expressions.

One small Python step turns a page into a flat list of its elements, each knowing its last descendant, and a list of
its strings. Everything else (selecting by tag, class or attribute, looking inside a container, reading its text) is a
filter over these arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from duelstats.functions.text import clean_text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DOM = T.StructType(
    [
        T.StructField(
            "elements",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("i", T.IntegerType()),
                        T.StructField("last", T.IntegerType()),
                        T.StructField("tag", T.StringType()),
                        T.StructField("classes", T.ArrayType(T.StringType())),
                        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField("strings", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("s", T.StringType())]))),
    ]
)


class _Flat(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.strings: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        i = len(self.elements)
        known = {name: value or "" for name, value in attrs}
        self.elements.append({"i": i, "last": i, "tag": tag, "classes": known.get("class", "").split(), "attrs": known})
        if tag not in VOID:
            self.open.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        at = next((n for n in range(len(self.open) - 1, -1, -1) if self.elements[self.open[n]]["tag"] == tag), None)
        if at is not None:
            self._close(at)

    def _close(self, at: int) -> None:
        for i in self.open[at:]:
            self.elements[i]["last"] = len(self.elements) - 1
        del self.open[at:]

    def handle_data(self, data):
        inside = self.elements[self.open[-1]] if self.open else {"tag": "", "i": -1}
        if data.strip() and inside["tag"] not in ("script", "style"):
            # a string belongs to the element opened last that is still open
            self.strings.append({"at": inside["i"], "s": data.strip()})


def _flatten(html: str | None) -> dict:
    page = _Flat()
    page.feed(html or "")
    page.close()
    page._close(0)
    return {"elements": page.elements, "strings": page.strings}


PAGES_AT_ONCE, CHARACTERS_AT_ONCE = 64, 1_000_000


def _portions(pages: pd.Series) -> Iterator[list]:
    """Pages in order, a few at a time; a portion ends at either bound."""
    portion, size = [], 0
    for text in pages:
        portion.append(text)
        size += len(text or "")
        if len(portion) >= PAGES_AT_ONCE or size >= CHARACTERS_AT_ONCE:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def _doms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The elements of a page take many times its text, so they are handed on portion by portion, however long a batch is."""
    for html in batches:
        for portion in _portions(html):
            yield pd.DataFrame([_flatten(text) for text in portion], columns=["elements", "strings"])


@F.pandas_udf(DOM)
def dom(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    yield from _doms(html)


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; a lambda body would evaluate it per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def below(e: Column, scopes: Column) -> Column:
    """Whether an element lies below any of some elements."""
    return F.exists(scopes, lambda s: (e["i"] > s["i"]) & (e["i"] <= s["last"]))


class Page:
    """Column view of one page's ``dom``."""

    def __init__(self, column: str = "dom"):
        self.elements, self.strings = F.col(f"{column}.elements"), F.col(f"{column}.strings")

    def select(self, test, scope: Column | None = None) -> Column:
        """Elements that pass ``test``, below ``scope`` if given, in page order; null without the scope."""
        if scope is None:
            return F.filter(self.elements, test)
        # the elements below a scope are the ones right after it
        return let(
            scope,
            lambda s: F.when(s.isNotNull(), F.filter(F.slice(self.elements, s["i"] + 2, s["last"] - s["i"]), test)),
        )

    def below_any(self, test, scopes: Column) -> Column:
        """Elements that pass ``test`` below any of ``scopes``."""
        return let(scopes, lambda found: F.filter(self.elements, lambda e: test(e) & below(e, found)))

    def first(self, test, scope: Column | None = None) -> Column:
        return F.get(self.select(test, scope), F.lit(0))

    def text(self, element: Column) -> Column:
        """Squeezed text below an element, '' when there is none."""

        def inside(e: Column) -> Column:
            own = F.filter(self.strings, lambda s: s["at"].between(e["i"], e["last"]))
            return clean_text(F.array_join(F.transform(own, lambda s: s["s"]), " "))

        return F.coalesce(let(element, inside), F.lit(""))

    def texts(self, elements: Column) -> Column:
        """Non-empty texts of elements."""
        return F.filter(F.transform(elements, self.text), lambda t: t != "")


def classed(*names: str):
    return lambda e: F.arrays_overlap(e["classes"], F.array(*[F.lit(n) for n in names]))


def tagged(tag: str, *names: str):
    if not names:
        return lambda e: e["tag"] == tag
    return lambda e: (e["tag"] == tag) & classed(*names)(e)


def attr(e: Column, name: str) -> Column:
    return F.coalesce(e["attrs"][name], F.lit(""))


def attr_has(name: str, part: str, tag: str | None = None):
    def test(e: Column) -> Column:
        found = attr(e, name).contains(part)
        return found & (e["tag"] == tag) if tag else found

    return test


def either(*tests):
    def test(e: Column) -> Column:
        out = tests[0](e)
        for t in tests[1:]:
            out = out | t(e)
        return out

    return test
