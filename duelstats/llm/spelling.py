"""Spelling variants: pairs of words one edit apart, by scans of sorted lists with a banded edit matrix.

1. Words are counted over the whole corpus. Words that differ by one edit, the longer of L letters, share their first or their last
   ceil((L - 1) / 2) letters, so a word enters the lists of both for L its length and one more. A list with more than ``most`` words
   is split in the same way within what its words don't share yet, down to one open letter, where it holds no more words than there
   are letters. So no list is long, and nothing is dropped.
2. Spark sorts each list. A task scans it for every word of it: the rows of the banded edit matrix are kept as far as the next word
   has the same prefix (the longest common prefix of neighbours), and where a row holds nothing below two, all words with that prefix
   are skipped. The scans of many words move forward side by side as numpy arrays.
3. A pair is reported where it was not yet put together by a shared beginning, so exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from duelstats.session import cut

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST = 1000  # words of a list
TOGETHER = 20_000  # words whose scans move side by side
FAR = 2  # an edit distance above one


def words(docs: DataFrame, least_letters: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``_id`` and ``_word``, one per occurrence: runs of letters of at least that many code points, A to Z in lower case."""
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"{LETTERS}{{{least_letters},}}+"), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.explode(runs).alias("_word"))
    return rows.withColumn("_word", F.translate("_word", UPPER, LOWER))


def slips(rows: DataFrame, one_in: int = 199) -> DataFrame:
    """``words`` with one letter left out of some: where ``one_in`` divides the checksum of id and word, the letter that it points to.

    A null identifier counts as the empty text.
    """
    told = F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("_word"))
    h = F.crc32(F.encode(told, "UTF-8"))
    at = (h % F.length("_word")).cast("int")
    less = F.concat(F.substring("_word", F.lit(1), at), F.substring("_word", at + 2, F.length("_word")))
    return rows.withColumn("_word", F.when(h % one_in == 0, less).otherwise(F.col("_word")))


def vocabulary(rows: DataFrame, least_letters: int = 6, least: int = 5) -> DataFrame:
    """``_word`` and how often it stands, ``_n``, for words of enough letters and occurrences."""
    return rows.where(F.length("_word") >= least_letters).groupBy("_word").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)


def _half(open_: Column) -> Column:
    return F.floor(open_ / 2).cast("int")  # ceil((open - 1) / 2)


def _split(rows: DataFrame) -> DataFrame:
    """Each word in two longer-keyed lists: by more of its beginning, and by more of its end.

    Words of a list share their first ``_head`` and last ``_tail`` letters and have ``_long`` or one less; pairs that share ``_seen``
    or more first letters are found elsewhere. Neither split loses a pair: one edit leaves all but one of the open letters alike,
    on its left or on its right.
    """
    half = _half(F.col("_long") - F.col("_head") - F.col("_tail"))
    head, tail = F.col("_head") + half, F.col("_tail") + half
    first = F.struct(head.alias("_head"), F.col("_tail"), F.col("_seen"), F.lit(False).alias("_back"))
    second = F.struct(F.col("_head"), tail.alias("_tail"), F.least(F.col("_seen"), head).alias("_seen"), F.lit(True).alias("_back"))
    both = rows.select("_word", "_n", "_long", F.explode(F.array(first, second)).alias("_s")).select("_word", "_n", "_long", "_s.*")
    named = both.withColumn("_key", F.concat_ws(" ", "_long", "_head", "_tail", "_back", "_seen", F.substring("_word", F.lit(1), F.col("_head")), F.expr("right(_word, _tail)")))
    return named.where(F.col("_head") < F.col("_seen"))


def _commons(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Letters that each word shares with the one before it (0 for the first), all words at once and letter by letter."""
    out = np.zeros(len(start), np.int64)
    at = np.arange(1, len(start))
    depth = 0
    while len(at):
        at = at[(length[at] > depth) & (length[at - 1] > depth)]
        at = at[points[start[at] + depth] == points[start[at - 1] + depth]]
        depth += 1
        out[at] = depth
    return out


def scan(lists: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of word numbers (through all lists, the smaller first) one edit apart within a sorted list of different words."""
    flat = [w for one in lists for w in one]
    if not flat:
        return
    sizes = np.array([len(one) for one in lists])
    end = np.repeat(np.cumsum(sizes), sizes)
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    points = np.frombuffer(("".join(flat) + "\0").encode("utf-32-le"), np.uint32)
    start = np.cumsum(length) - length
    common = _commons(points, start, length)
    common[np.r_[0, np.cumsum(sizes)[:-1]]] = -1  # a list's first word stops all skips
    common = np.r_[common, -1]
    # the next word that shares fewer letters with its neighbour
    leap = np.arange(1, len(common) + 1)
    stack: list[int] = []
    for k, c in enumerate(common.tolist()):
        while stack and common[stack[-1]] > c:
            leap[stack.pop()] = k
        stack.append(k)

    # rows of the matrix, one word's behind another's: cells one before, on and one after the diagonal
    base = np.cumsum(length + 2) - length - 2
    rows = np.ones((int((length + 2).sum()), 3), np.uint8)
    rows[:, 1] = 0
    rows[base, 0] = FAR
    rows[base + length, 2] = FAR

    query = np.flatnonzero(np.arange(len(flat)) + 1 < end)
    other = query + 1
    depth = np.maximum(common[other], 0)
    limit = np.full(len(query), np.iinfo(np.int64).max)  # words sharing so many letters with their neighbour are skipped
    while len(query):
        skip = common[other] >= limit
        live = np.flatnonzero(~skip)
        q, o, d = query[live], other[live], depth[live]
        # one more row: letter d of the other word against letters d-1, d and d+1 of the word that is looked for
        over = length[o] <= d  # the other word is a prefix of the last one and has its rows already
        letter = points[start[o] + np.minimum(d, length[o] - 1)]
        o0, o1, o2 = rows[base[q] + d].T
        at, last = start[q], length[q]
        unlike = lambda k: points[at + np.clip(k, 0, last - 1)] != letter
        n0 = np.minimum(np.where(d >= 1, o0 + unlike(d - 1), FAR), o1 + 1)
        n1 = np.where(d < last, np.minimum(np.minimum(o1 + unlike(d), o2 + 1), n0 + 1), FAR)
        n2 = np.where(d + 1 < last, np.minimum(o2 + unlike(d + 1), n1 + 1), FAR)
        new = np.minimum(np.stack([n0, n1, n2], 1), FAR).astype(np.uint8)
        new[over] = rows[base[q] + d][over]
        d = np.where(over, d, d + 1)
        fits = d <= last + 1
        rows[(base[q] + d)[fits]] = new[fits]
        dead = (new.min(1) >= FAR) | ~fits
        ends = ~dead & (d >= length[o])
        off = last - d + 1
        found = ends & (off >= 0) & (off <= 2)
        found[found] = new[found, off[found]] == 1
        if found.any():
            yield q[found], o[found]
        # where the scan goes on
        limit[live] = np.where(dead, d, np.iinfo(np.int64).max)
        depth[live] = d
        step = np.zeros(len(query), bool)
        step[live] = dead | ends
        other = np.where(skip, leap[other], np.where(step, other + 1, other))
        here = other < end[query]
        moved = step & here
        depth[moved] = np.minimum(depth[moved], np.maximum(common[other[moved]], 0))
        jumped = skip & here
        depth[jumped] = np.minimum(depth[jumped], np.maximum(common[other[jumped]], 0))
        if not here.all():
            query, other, depth, limit = (x[here] for x in (query, other, depth, limit))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (_key, _view, _n, _long, _seen, _back) to links in both directions."""
    held: list[tuple] = []  # whole lists: words, counts, long, seen, back
    here: list | None = None
    size = 0

    def settle() -> Iterator[pa.RecordBatch]:
        views = [v for one in held for v in one[1]]
        n = [c for one in held for c in one[2]]
        what = [one[3] for one in held for _ in one[1]]
        for a, b in scan([one[1] for one in held]):
            out = []
            for x, y in zip(a.tolist(), b.tolist()):
                long, seen, back = what[x]
                v, w = views[x], views[y]
                if max(len(v), len(w)) != long:
                    continue
                if back:
                    v, w = v[::-1], w[::-1]
                if v[:seen] == w[:seen] and min(len(v), len(w)) >= seen:
                    continue
                out += [(v, w, n[y]), (w, v, n[x])]
            if out:
                one, two, many = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(many, pa.int64())], names=["_word", "_near", "_near_n"])

    for batch in batches:
        key, view, n, long, seen, back = (c.to_pylist() for c in batch.columns)
        for k in range(len(key)):
            if here is None or here[0] != key[k]:
                if size >= TOGETHER:
                    yield from settle()
                    held, size = [], 0
                here = [key[k], [], [], (long[k], seen[k], back[k])]
                held.append(here)
            here[1].append(view[k])
            here[2].append(n[k])
            size += 1
    yield from settle()


def near_words(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """All ordered pairs of different words one inserted, deleted or replaced code point apart: ``_word``, ``_near`` and ``_near_n``.

    ``vocab`` has ``_word`` (different, not empty) and ``_n``. Lists of more than ``most`` words are split until they are shorter or
    differ in one letter only.
    """
    length = F.length("_word")
    start = vocab.select("_word", F.col("_n").cast("bigint").alias("_n"), F.explode(F.array(length, length + 1)).alias("_long"))
    rows = _split(start.select("*", F.lit(0).alias("_head"), F.lit(0).alias("_tail"), (F.col("_long") + 1).alias("_seen")))
    ready: DataFrame | None = None
    while rows is not None:
        rows = cut(rows)
        sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
        sized = rows.join(sizes, "_key").withColumn("_wide", (F.col("_size") > most) & (F.col("_long") - F.col("_head") - F.col("_tail") > 1))
        sized = cut(sized)
        short = sized.where(~F.col("_wide"))
        ready = short if ready is None else ready.unionByName(short)
        wide = sized.where("_wide")
        rows = None if wide.isEmpty() else _split(wide)
    view = F.when(F.col("_back"), F.reverse("_word")).otherwise(F.col("_word"))
    listed = ready.select("_key", view.alias("_view"), "_n", "_long", "_seen", "_back").repartition("_key").sortWithinPartitions("_key", "_view")
    return listed.mapInArrow(_links, "_word string, _near string, _near_n bigint")


def variants(vocab: DataFrame, times: int = 5, most: int = MOST) -> DataFrame:
    """``vocab`` with ``_near`` (how many words are near), ``_form``, ``_form_n`` and ``_root``.

    The form of a word is its most frequent near word, the first in code-point order among equals, if that is at least ``times`` as
    frequent; the root is where forms lead to in the end, the word itself if it has none. Every form is more frequent than its word, so
    there are no circles. An empty vocabulary gives an empty result.
    """
    links = near_words(vocab, most)
    best = links.groupBy("_word").agg(F.count(F.lit(1)).alias("_many"), F.min(F.struct((-F.col("_near_n")).alias("_less"), F.col("_near").alias("_form"))).alias("_best"))
    found = vocab.join(best, "_word", "left").select(
        "_word", "_n", F.coalesce("_many", F.lit(0)).cast("bigint").alias("_near"), F.when(-F.col("_best._less") >= times * F.col("_n"), F.col("_best")).alias("_best")
    )
    found = cut(found.select("_word", "_n", "_near", F.col("_best._form").alias("_form"), (-F.col("_best._less")).alias("_form_n")))
    return found.join(roots(found), "_word", "left").withColumn("_root", F.coalesce("_root", "_word"))


def roots(found: DataFrame) -> DataFrame:
    """``_word`` and ``_root`` of the words that have a form; ways double their length with every round."""
    ways = cut(found.where("_form IS NOT NULL").select("_word", F.col("_form").alias("_root")))
    while True:
        ahead = ways.select(F.col("_word").alias("_root"), F.col("_root").alias("_next"))
        ways = cut(ways.join(ahead, "_root", "left").select("_word", F.coalesce("_next", "_root").alias("_root"), F.col("_next").isNotNull().alias("_moved")))
        if ways.where("_moved").isEmpty():
            return ways.drop("_moved")
        ways = ways.drop("_moved")
