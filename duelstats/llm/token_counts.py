"""Token counts: the tokenizer runs in Arrow functions that give back lengths only.

Texts are cut at single blanks between two characters that are not white space, where the pre-tokenizer always starts a new piece, so
a piece's tokens don't depend on its neighbours. The pieces of a batch are cut, told apart and added up in Arrow and numpy; only
different ones are encoded, in batches of bounded bytes, and the length of a short piece is remembered per worker in a table of bounded
size. A text of any length is never encoded as one string unless it has no such place.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BATCH_BYTES = 1 << 20
SLICE_BYTES = 4 << 20  # texts that are cut at a time
REMEMBERED = 400_000
SHORT = 40

_tokenizers: dict[str, object] = {}


def tokenizer(name: str):
    """The tokenizer of a vocabulary file, loaded once per worker, without truncation or padding."""
    if name not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        import public_tokenizers
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(public_tokenizers.path(name))
        made.no_truncation()
        made.no_padding()
        _tokenizers[name] = made
    return _tokenizers[name]


def lengths(name: str, pieces: list[str]) -> list[int]:
    """Tokens of each piece, encoded in batches of about ``BATCH_BYTES``."""
    encode = tokenizer(name).encode_batch_fast  # without offsets
    out: list[int] = []
    batch: list[str] = []
    held = 0
    for piece in pieces:
        batch.append(piece)
        held += len(piece)
        if held >= BATCH_BYTES:
            out += [len(e.ids) for e in encode(batch, add_special_tokens=False)]
            batch, held = [], 0
    if batch:
        out += [len(e.ids) for e in encode(batch, add_special_tokens=False)]
    return out


class Counter:
    """Tokens of texts by their pieces; the lengths of short pieces are remembered."""

    def __init__(self, name: str):
        self.name, self.known = name, {}

    def _sizes(self, pieces: list[str]) -> np.ndarray:
        """Tokens of different pieces."""
        new = [p for p in pieces if p not in self.known]
        found = dict(zip(new, lengths(self.name, new)))
        out = np.fromiter((found[p] if p in found else self.known[p] for p in pieces), np.int64, len(pieces))
        if len(self.known) + len(found) > REMEMBERED:
            self.known = {}
        self.known |= {p: n for p, n in list(found.items())[:REMEMBERED] if len(p) <= SHORT}
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (none null)."""
        if not len(texts):
            return np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        start = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()  # every text has one piece at least
        coded = cut.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        opens = np.fromiter((w != "" and not w[0].isspace() for w in words), bool, len(words))
        closes = np.fromiter((w != "" and not w[-1].isspace() for w in words), bool, len(words))
        first = np.zeros(len(code), bool)
        first[start] = True
        # a piece runs from one safe blank to the next, over unsafe ones
        begins = first.copy()
        begins[1:] |= closes[code[:-1]] & opens[code[1:]]
        at = np.flatnonzero(begins)
        end = np.r_[at[1:], len(code)]
        plain = (end - at == 1) & ~first[at]
        size = np.zeros(len(at), np.int64)
        used, back = np.unique(code[at[plain]], return_inverse=True)
        size[plain] = self._sizes([" " + words[k] for k in used.tolist()])[back]
        others = [" " * (not head) + " ".join([words[k] for k in code[a:b].tolist()]) for a, b, head in zip(at[~plain].tolist(), end[~plain].tolist(), first[at[~plain]].tolist())]
        different = {p: k for k, p in enumerate(dict.fromkeys(others))}
        if others:
            size[~plain] = self._sizes(list(different))[[different[p] for p in others]]
        return np.add.reduceat(size, np.searchsorted(at, start))


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``SLICE_BYTES``, one text at least."""
    passed = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(passed[1:] != passed[:-1]) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield texts.slice(a, b - a)


_counters: dict[str, Counter] = {}


def _counter(name: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(name, Counter(name))  # a worker keeps its table over its tasks
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            totals = np.concatenate([np.zeros(0, np.int64), *(counter.count(part) for part in slices(texts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(totals, pa.int64())], names=["_id", "_bytes", "_tokens"])

    return count


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``_bytes`` (UTF-8) and ``_tokens``.

    Null and empty texts have none of either. Special strings inside a text count as the library's default counts them. Rows are
    counted one by one, so repeated rows and identifiers change nothing; an empty table gives an empty result, and further
    columns are not read. Spark's file splits balance the tasks by bytes.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_counter(vocabulary), f"_id {kind}, _bytes bigint, _tokens bigint")
