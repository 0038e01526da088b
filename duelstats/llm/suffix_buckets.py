"""Removal of repeated byte strings by bucket refinement.

A string of ``LENGTH`` bytes is repeated when another position starts with the same bytes. Positions are sorted into buckets by their
first bytes and buckets are refined by the identifiers of what stands at further offsets, until they are ``LENGTH`` deep; a position
alone in its bucket is finished, and each round works only on what the one before left open. Identifiers are digests of the bytes they
stand for, so all tasks give the same name to the same bucket without meeting.

1. Of every window of ``LENGTH`` bytes one q-gram stands for it: the least by hash, the first among equals. It depends on the window
   alone, so equal windows share it, and about one position in 85 is sorted at first. Buckets with one q-gram are dropped.
2. A q-gram's windows are split by their distance to it into parts of ``PART``. The bytes that all windows of a part share name the
   refined bucket, and the bytes that any of them covers tell whether the whole part is repeated.
3. Only where a bucket holds differing surroundings, one position of each kind goes on and is refined to whole windows.

Every round counts identifiers with map-side sums; no bucket is gathered, however large. Long documents are one row, as they came.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from duelstats.llm.base import land
from duelstats.session import cut, release

LENGTH = 200
GRAM = 32
PART = 24
SLIDE = LENGTH - GRAM + 1  # q-grams in a window
PLACES = np.uint64((1 << 24) - 1)  # bits of a hash that give way to a place
BLOCK = 1 << 23  # windows whose q-grams are chosen at a time

_bytes_as = np.random.default_rng(11).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


def fingerprints(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes from every position."""
    h, width = _bytes_as[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        width *= 2
    return h


def chosen(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, and per window the place of its q-gram; empty for texts shorter than a window."""
    if len(data) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = fingerprints(data)
    return h, np.concatenate([_least(h[start : start + BLOCK + SLIDE - 1]) + start for start in range(0, len(h) - SLIDE + 1, BLOCK)])


def _least(h: np.ndarray) -> np.ndarray:
    """Per row of ``SLIDE`` hashes the place of the least by its high bits, the first among equals; the low bits give way to the place."""
    best, width = (h & ~PLACES) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= SLIDE:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if SLIDE > width:
        best = np.minimum(best[: width - SLIDE], best[SLIDE - width :])
    return (best & PLACES).astype(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            docs, buckets, places = [], [], []
            for doc, text in zip(*(c.slice(start, 256).to_pylist() for c in batch.columns)):
                h, at = chosen(np.frombuffer(text.encode(), np.uint8))
                once = np.unique(at)
                buckets.append(h[once].view(np.int64))
                places.append(once)
                docs.append(np.full(len(once), doc, np.int64))
            arrays = [pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in (buckets, docs, places)]
            yield pa.RecordBatch.from_arrays([arrays[0], arrays[1], arrays[2].cast(pa.int32())], names=["_bucket", "_doc", "_at"])


def _open_windows(data: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose q-gram is in a shared bucket, and its place."""
    _, at = chosen(data)
    shared = np.zeros(len(data) + 1, bool)
    shared[active] = True
    starts = np.flatnonzero(shared[at])
    return starts, at[starts]


def part_span(part: int) -> tuple[int, int]:
    """Least and greatest distance of a part."""
    return part * PART, min(part * PART + PART - 1, SLIDE - 1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = np.array([part_span(k) for k in range(-(-SLIDE // PART))])
    core_of, hull_of, low = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest, 1 << 63
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            docs, places, parts, cores, hulls = [], [], [], [], []
            for doc, text, active in zip(*(c.slice(start, 64).to_pylist() for c in batch.columns)):
                raw = text.encode()
                starts, at = _open_windows(np.frombuffer(raw, np.uint8), np.unique(np.array(active, np.int64)))
                both = np.unique(at * len(spans) + (at - starts) // PART)
                place, part = both // len(spans), both % len(spans)
                near, far = place - spans[part, 0], place - spans[part, 1]
                docs.append(np.full(len(both), doc, np.int64))
                places.append(place)
                parts.append(part)
                cores += [core_of(raw[x:y], k) - low for x, y, k in zip(near.tolist(), (far + LENGTH).tolist(), part.tolist())]
                hulls += [hull_of(raw[x:y]) if x >= 0 and y <= len(raw) else None for x, y in zip(far.tolist(), (near + LENGTH).tolist())]
            arrays = [pa.array(np.concatenate([np.empty(0, np.int64), *x]), t, safe=False) for x, t in ((docs, pa.int64()), (places, pa.int32()), (parts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cores, pa.int64()), pa.array(hulls, pa.binary())], names=["_doc", "_at", "_part", "_core", "_hull"])


def _fields(rows: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """Where each row's structs begin (and the last one's end), and their fields one after the other."""
    flat = rows.flatten()
    return np.r_[0, np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))], *(flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_parts, digest = -(-SLIDE // PART), xxhash.xxh3_128_digest
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            some = batch.slice(start, 64)
            edges, places, parts, counts = _fields(some.column(3), "_at", "_part", "_count")
            rows: tuple[list, ...] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [], [np.empty(0, np.int64)])
            for k, (doc, text, active) in enumerate(zip(*(c.to_pylist() for c in some.columns[:3]))):
                raw, own = text.encode(), slice(edges[k], edges[k + 1])
                starts, at = _open_windows(np.frombuffer(raw, np.uint8), np.unique(np.array(active, np.int64)))
                wanted, first = np.unique(places[own] * n_parts + parts[own], return_index=True)
                keys = at * n_parts + (at - starts) // PART
                found = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                hit = wanted[found] == keys
                begins = starts[hit]
                rows[0].append(np.full(len(begins), doc, np.int64))
                rows[1].append(begins)
                rows[2].extend([digest(raw[x : x + LENGTH]) for x in begins.tolist()])
                rows[3].append(counts[own][first][found[hit]])
            arrays = [pa.array(np.concatenate(rows[0])), pa.array(np.concatenate(rows[1]).astype(np.int32)), pa.array(rows[2], pa.binary()), pa.array(np.concatenate(rows[3]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_doc", "_from", "_key", "_count"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, gone, runs, shas, texts = [], [], [], [], []
        edges, begins, ends = _fields(batch.column(2), "_from", "_to")
        for k, (doc, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:2]))):
            raw, own = text.encode(), slice(edges[k], edges[k + 1])
            edge = np.bincount(begins[own], minlength=len(raw) + 1) - np.bincount(ends[own], minlength=len(raw) + 1)
            covered = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
            docs.append(doc)
            gone.append(int(covered.sum()))
            runs.append(int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()))
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary())], names=["_doc", "_removed", "_spans", "_sha", "_kept"])


def repeated_spans(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (``_doc``, ``_text``), written by ``land``: the texts that may hold repeats, and the stretches (``_doc``, ``_from``, ``_to``) that
    repeated strings cover. Every table is removed as soon as the next one is there, ``landed`` too, so that few of them are on disk at a time."""
    grams = cut(landed.select("_doc", "_text").mapInArrow(_grams, "_bucket bigint, _doc bigint, _at int"))
    again = grams.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_bucket")
    active = cut(grams.join(again, "_bucket").groupBy("_doc").agg(F.collect_list("_at").alias("_active")))
    release(grams)
    texts = land(landed.select("_doc", "_text").join(active, "_doc"))
    release(landed)
    release(active)

    parts = cut(texts.select("_doc", "_text", "_active").mapInArrow(_parts, "_doc bigint, _at int, _part int, _core bigint, _hull binary"))
    kinds = cut(parts.groupBy("_core", "_hull").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_doc", "_at", "_part")).alias("_first")))
    cores = kinds.groupBy("_core").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_kinds"), F.max(F.col("_hull").isNull()).alias("_cropped"))
    open_ = cut(cores.where((F.col("_all") > 1) & ((F.col("_kinds") > 1) | F.col("_cropped"))).select("_core"))
    again = cut(kinds.where("_hull is not null and _n > 1").select("_core", "_hull"))
    one_each = cut(kinds.where("_hull is not null").join(open_, "_core").select("_first.*", F.least("_n", F.lit(2)).cast("bigint").alias("_count")))
    release(kinds)

    near = F.col("_part") * PART
    far = F.least(near + PART - 1, F.lit(SLIDE - 1))
    same = parts.join(again, ["_core", "_hull"])
    whole = cut(same.select("_doc", (F.col("_at") - far).alias("_from"), (F.col("_at") - near + LENGTH).alias("_to")))

    cropped = parts.where("_hull is null").join(open_, "_core").select("_doc", "_at", "_part", F.lit(1).cast("bigint").alias("_count"))
    asked = cut(one_each.unionByName(cropped).groupBy("_doc").agg(F.collect_list(F.struct("_at", "_part", "_count")).alias("_asked")))
    for table in (parts, again, one_each, open_):
        release(table)
    windows = cut(texts.join(asked, "_doc").select("_doc", "_text", "_active", "_asked").mapInArrow(_windows, "_doc bigint, _from int, _key binary, _count bigint"))
    twice = windows.groupBy("_key").agg(F.sum("_count").alias("_n")).where("_n > 1").select("_key")
    single = windows.join(twice, "_key").select("_doc", "_from", (F.col("_from") + LENGTH).alias("_to"))
    return texts, whole.unionByName(single)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``_bytes``, ``_removed``, ``_spans`` (maximal removed stretches), ``_sha`` of the bytes that stay, and these as
    ``_kept`` where something was removed (else null).

    A byte goes when some string of ``LENGTH`` bytes over it also starts elsewhere, in this or another document, as the input has them.
    Null and empty texts have no bytes; repeated rows are copies of each other, whatever their identifiers; an empty table
    gives an empty result; further columns aren't read.
    """
    landed = land(docs.select(F.monotonically_increasing_id().alias("_doc"), F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")))
    whole = cut(landed.select("_doc", "_id", F.octet_length("_text").cast("bigint").alias("_bytes"), F.sha2(F.encode("_text", "UTF-8"), 256).alias("_all")))
    texts, spans = repeated_spans(landed)
    each = cut(spans.groupBy("_doc").agg(F.collect_list(F.struct("_from", "_to")).alias("_s")))
    cleaned = texts.select("_doc", "_text").join(each, "_doc").mapInArrow(_removed, "_doc bigint, _removed bigint, _spans bigint, _sha string, _kept binary")
    zero = F.lit(0).cast("bigint")
    return whole.join(cleaned, "_doc", "left").select(
        "_id", "_bytes", F.coalesce("_removed", zero).alias("_removed"), F.coalesce("_spans", zero).alias("_spans"), F.coalesce("_sha", "_all").alias("_sha"), "_kept"
    )
