"""Quality by importance resampling.

Two bag models over hashed word one- and two-grams, one of target texts and one of all raw texts, give every document a log ratio of
probabilities. Adding Gumbel noise to it and keeping the largest draws documents without replacement in proportion to
their importance. The noise comes from a hash of the identifier, so reruns agree; the cut is found from nested histograms, not a sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from duelstats.llm.mixing import BITS, LEVELS, thresholds, within_budget
from duelstats.llm.tokens import Hashes, hashed, mixed
from duelstats.session import cut

BUCKETS = 1 << 15
TARGET_ROWS = 20_000  # bound of the labelled rows that the target model is fitted on
SMOOTH = 1.0


def features(text: str | None, known: Hashes) -> np.ndarray:
    """Hash buckets of the words and word pairs of a text."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.int64)
    one = hashed(words, known)
    two = mixed(one[:-1] * np.uint64(31) + one[1:])
    return (np.concatenate([mixed(one), two]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    totals = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.bincount(features(text, known), minlength=BUCKETS)
            totals[0] += found
            if target:
                totals[1] += found
    at = np.flatnonzero(totals[0])
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[0][at]), pa.array(totals[1][at])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Per bucket the log of target over raw probability, counted over all documents. ``target_ids`` (``_id``) is small."""
    ids = F.broadcast(target_ids.distinct().withColumn("_target", F.lit(True)))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(ids, "_id", "left").select("_text", "_target")
    sums = rows.mapInArrow(_count, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.zeros((2, BUCKETS))
    for r in sums.collect():  # at most BUCKETS rows
        counts[:, r.bucket] = r.raw, r.target
    share = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    return np.log(share[1]) - np.log(share[0])


def _scorer(ratio: np.ndarray, seed: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            weights = np.array([float(ratio[features(t, known)].sum()) for t in texts.to_pylist()], np.float64)
            drawn = np.array([(xxhash.xxh64_intdigest(str(i), seed) + 0.5) / 2.0**64 for i in ids.to_pylist()], np.float64)
            keys = weights - np.log(-np.log(np.clip(drawn, 1e-18, 1 - 1e-16)))
            bits = (keys + 0.0).view(np.int64)  # doubles in the order of their bits, the largest first
            rising = np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)
            codes = ((~rising) >> np.uint64(64 - BITS * LEVELS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(weights), pa.array(keys), pa.array(codes)], names=["_id", "_weight", "_draw", "_hash"])

    return score


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality", share: float | None = None, target_rows: int = TARGET_ROWS, seed: int = 7) -> DataFrame:
    """One row per document: ``_id``, ``_weight`` (log importance), ``_draw`` (with noise), ``_selected``.

    The target model is fitted on at most ``target_rows`` documents labelled 1, chosen by hash. ``share`` of all documents are selected; by
    default the share of labelled documents that are labelled 1, or all without labels. Null and empty texts weigh 0; of rows that draw
    alike (repeated rows) as many are selected as the budget has room for; an empty table gives an empty result; further columns aren't read.
    """
    rated = labels.select(F.col(f"`{label_id}`").alias("_id"), F.col(f"`{label}`").alias("_label")).where("_id is not null")
    good = rated.where("_label = 1").select("_id").distinct()
    ids = cut(good.orderBy(F.xxhash64("_id"), "_id").limit(target_rows))
    if share is None:
        seen = rated.where("_label is not null").agg(F.avg((F.col("_label") == 1).cast("double"))).first()[0]
        share = 1.0 if seen is None else seen
    ratio = log_ratios(docs, ids, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    scored = cut(rows.mapInArrow(_scorer(ratio, seed), f"_id {kind}, _weight double, _draw double, _hash bigint").withColumn("_row", F.monotonically_increasing_id()))
    # the budget is a number of rows
    sized = scored.withColumns({"_key": F.lit(""), "_size": F.lit(1).cast("bigint")})
    budget = scored.agg(F.count(F.lit(1)).alias("_rows")).select(F.lit("").alias("_key"), F.round(F.col("_rows") * F.lit(float(share))).alias("_budget"))
    chosen = within_budget(sized, thresholds(sized.select("_key", "_hash", "_size"), budget))
    return chosen.select("_id", "_weight", "_draw", F.col("_in").alias("_selected"))
