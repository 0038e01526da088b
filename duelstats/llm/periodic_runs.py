"""Runs of periodic words: maximal pairs of a document's suffixes, from its tree of LCP intervals.

A stretch of words with period q that can't be extended is a pair of places q apart whose suffixes share all but the first q words of
the stretch, whose left words differ and whose common prefix ends there: a maximal pair at the distance q. So the maximal pairs whose
distance is at most their common prefix are exactly the stretches of two periods or more, and none has to be extended.

Texts are read in batches. In documents with a stretch of words that stands twice, suffixes are sorted by doubling, neighbours'
common prefixes are read off the ranks of all rounds, and the LCP intervals are gone through from the bottom up. An interval holds its
places as sorted lists by left word. Where two children meet, each place of the smaller looks for places of the other within reach and
with another left word; then the smaller goes into the larger. A stretch of period q is also found as one of 2q, 3q and so on; the
smallest distance counts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from duelstats.llm.token_counts import slices
from duelstats.llm.tokens import mixed

LEAST = 12  # words of a run


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts (none null) between ASCII white space, one after another, and how many each text has."""
    offset = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if offset[-1] == offset[0]:
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offset[0] : offset[-1]].copy()
    data[(data >= 9) & (data <= 13)] = 32
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offset - offset[0]), pa.py_buffer(data))
    cut = pc.split_pattern(plain, " ")
    flat, starts = cut.flatten(), cut.offsets.to_numpy()
    filled = pc.greater(pc.binary_length(flat), 0)
    many = np.add.reduceat(filled.to_numpy(zero_copy_only=False), starts[:-1] - starts[0], dtype=np.int64)
    return flat.filter(filled).dictionary_encode(), many


def repeating(code: np.ndarray, many: np.ndarray, width: int) -> np.ndarray:
    """Which texts hold a stretch of ``width`` words twice (by 64-bit hash: a few may be named in vain, none is missed)."""
    doc = np.repeat(np.arange(len(many)), many)
    if len(code) < width:
        return np.zeros(len(many), bool)
    x = mixed(code.astype(np.uint64) + np.uint64(1))
    h = x[: len(x) - width + 1]
    for k in range(1, width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - width + 1 + k]
    inside = doc[: len(h)] == doc[width - 1 :]
    h, doc = mixed(h[inside]) + mixed(doc[: len(inside)][inside].astype(np.uint64) + np.uint64(7)), doc[: len(inside)][inside]
    order = np.argsort(h)
    twice = order[1:][h[order[1:]] == h[order[:-1]]]
    out = np.zeros(len(many), bool)
    out[doc[twice]] = True
    return out


def suffixes(code: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by what follows them within their text (an end comes first), texts one after another, and the words that each
    shares with the one before it."""
    size = len(code)
    doc = np.repeat(np.arange(len(many)), many)
    end = np.repeat(np.cumsum(many), many)
    rank = np.zeros(size, np.int64)
    key = doc * (int(code.max()) + 1) + code
    active, place = np.arange(size), np.zeros(size, np.int64)  # places still told apart, and the first rank of their group
    levels, step, sorted_ = [], 0, np.zeros(size, np.int64)
    while True:
        order = np.lexsort((key, place))
        active, place, key = active[order], place[order], key[order]
        leads = np.r_[True, place[1:] != place[:-1]]
        splits = leads | np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(active))
        group = place + at - np.maximum.accumulate(np.where(leads, at, 0))  # rank if all were different
        rank[active] = group[np.maximum.accumulate(np.where(splits, at, 0))]
        sorted_[group] = active
        levels.append(np.append(rank, -1).astype(np.int32))
        alone = splits & np.r_[splits[1:], True]
        if alone.all():
            break
        active = np.sort(active[~alone])
        place = rank[active]
        step = max(1, 2 * step)
        ahead = active + step
        key = np.where(ahead < end[active], rank[np.minimum(ahead, size - 1)] + 1, 0)
    a, b = sorted_[:-1].copy(), sorted_[1:].copy()
    common = np.zeros(size, np.int64)
    for power in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[power][np.minimum(a, size)] == levels[power][np.minimum(b, size)])
        same = same[(a[same] < size) & (b[same] < size)]
        common[same + 1] += 1 << power
        a[same] += 1 << power
        b[same] += 1 << power
    return sorted_, common


class Places:
    """Places of an interval: all in order, and by left word."""

    __slots__ = ("all", "by")

    def __init__(self, place: int, left: int):
        self.all, self.by = [place], {left: [place]}


def _meet(one: Places, two: Places, common: int, left: list[int], out: list[tuple[int, int, int]]) -> Places:
    """Reports the maximal pairs between two children of an interval and joins them."""
    few, lot = (one, two) if len(one.all) <= len(two.all) else (two, one)
    nearest = max(1, LEAST - common)
    everywhere, by = lot.all, lot.by
    for x in few.all:
        a, b = bisect_left(everywhere, x - common), bisect_right(everywhere, x + common)
        if a == b:
            continue
        own = left[x]
        if b - a <= len(by):
            hits = [y for y in everywhere[a:b] if left[y] != own]
        else:
            hits = [y for word, places in by.items() if word != own for y in places[bisect_left(places, x - common) : bisect_right(places, x + common)]]
        for y in hits:
            apart = abs(x - y)
            if apart >= nearest:
                out.append((min(x, y), apart, apart + common))
    for x in few.all:
        insort(everywhere, x)
        own = left[x]
        if own in by:
            insort(by[own], x)
        else:
            by[own] = [x]
    return lot


def maximal_pairs(order: list[int], common: list[int], left: list[int], out: list[tuple[int, int, int]]) -> None:
    """Start, distance and length of the stretches that one subtree's maximal pairs make; ``common[k]`` belongs to k - 1 and k."""
    open_: list[list] = []
    for k in range(1, len(order) + 1):
        node, depth = Places(order[k - 1], left[order[k - 1]]), common[k] if k < len(order) else -1
        while open_ and open_[-1][0] > depth:
            shared, first = open_.pop()
            node = _meet(first, node, shared, left, out)
        if open_ and open_[-1][0] == depth:
            open_[-1][1] = _meet(open_[-1][1], node, depth, left, out)
        elif depth >= 0:
            open_.append([depth, node])


def runs_of(code: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period of all runs, from the words' codes and how many each text has."""
    least = LEAST // 2  # a run's suffixes share half of its words at least
    named = np.flatnonzero(repeating(code, many, least))
    if not len(named):
        return np.zeros((0, 4), np.int64)
    starts = np.cumsum(many) - many
    base = starts[named]
    some = many[named]
    within = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
    code = code[np.repeat(base, some) + within]
    order, common = suffixes(code, some)
    left = np.where(within == 0, -1, np.r_[-1, code[:-1]])
    close = common >= least
    found = []
    head = np.flatnonzero(close & ~np.r_[False, close[:-1]]) - 1  # first place of a subtree
    tail = np.flatnonzero(close & ~np.r_[close[1:], False]) + 1
    pair = tail - head == 2
    # two places alone
    x, y, c = order[head[pair]], order[head[pair] + 1], common[head[pair] + 1]
    apart = np.abs(x - y)
    good = (apart <= c) & (apart + c >= LEAST) & (left[x] != left[y])
    found.append(np.stack([np.minimum(x, y), apart, apart + c], 1)[good])
    rows: list[tuple[int, int, int]] = []
    if not pair.all():
        left_list = left.tolist()
        for a, b in zip(head[~pair].tolist(), tail[~pair].tolist()):
            maximal_pairs(order[a:b].tolist(), common[a:b].tolist(), left_list, rows)
    found.append(np.array(rows, np.int64).reshape(-1, 3))
    start, period, length = np.concatenate(found).T
    best = np.lexsort((period, length, start))
    start, period, length = start[best], period[best], length[best]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, period, length = start[new], period[new], length[new]
    text = np.searchsorted(np.cumsum(some), start, "right")
    out = np.stack([named[text], within[start], length, period], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        texts, passed = pc.fill_null(batch.column(1), ""), 0
        for part in slices(texts):
            words, many = words_of(part)
            code = words.indices.to_numpy()
            rows = runs_of(code, many)
            starts = np.cumsum(many) - many
            # the words of a run behind its first period go
            text, start, length, period = rows.T
            change = np.zeros(len(code) + 1, np.int64)
            np.add.at(change, starts[text] + start + period, 1)
            np.add.at(change, starts[text] + start + length, -1)
            keep = np.cumsum(change[:-1]) == 0
            kept = np.r_[0, np.cumsum(keep)][np.r_[starts, len(code)]]
            left = words.dictionary.take(pa.array(code[keep]))
            lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), left)
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kind))
            by_text = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(part) + 1)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(passed, len(part)), by_text, pc.binary_join(lists, " ")], names=["_id", "_runs", "_collapsed"])
            passed += len(part)


def periodic_runs(docs: DataFrame, text: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``_runs`` (start, length and period by start, then period) and ``_collapsed``.

    Words stand between ASCII white space and are numbered from 0. A run has 12 words or more and at least two periods, and neither
    neighbour continues its smallest period. ``_collapsed`` are the words without those that any run repeats, joined by one blank.
    Null and empty texts have no words. Rows are read one by one, so repeated rows and identifiers change nothing; an empty table
    gives an empty result, and further columns, whatever their names, are not read. ``text`` may be given as a Column instead.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), (F.col(f"`{text_col}`") if text is None else text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_read, f"_id {kind}, _runs array<struct<start:bigint,length:bigint,period:bigint>>, _collapsed string")


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and ``_text``, where every tenth text (by the checksum of its identifier) repeats a period from some word on.

    Texts without words and rows without identifier stay as they are.
    """
    h = F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "UTF-8"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), h.alias("_h"))
    rows = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    rows = rows.select("_id", "_text", "_words", F.when(n > 0, g % n).cast("int").alias("_a"), (g % 8 + 3).cast("int").alias("_times"))
    rows = rows.select("_id", "_text", "_words", "_a", (F.floor((F.size("_words") - F.col("_a")) / F.col("_times")) + 1).cast("int").alias("_p"))
    a, p = F.col("_a"), F.col("_p")
    said = F.transform("_words", lambda w, i: F.when(i < a, w).otherwise(F.get("_words", a + F.pmod(i - a, p))))
    return rows.select("_id", F.when(a.isNotNull(), F.array_join(said, " ")).otherwise(F.col("_text")).alias("_text"))
