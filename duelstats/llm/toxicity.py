"""Toxicity by a support vector machine over a gap-weighted subsequence kernel.

The kernel of two strings sums over all common subsequences of ``ORDER`` characters, each weighted by ``DECAY`` to the power of the
lengths it spans in both, so a word with inserted characters stays near the word itself. Landmark strings, cut from the labelled
sentences, make it finite: a string is described by its kernel values with the landmarks (Nystroem), a sentence by the largest value of
its words per landmark, and a document by its worst sentence. Labels are given by document, so training alternates between
picking each document's worst sentence and fitting the machine to these. The model is a few kilobytes and goes to the tasks as it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from duelstats.session import cut

ORDER, DECAY = 4, 0.7
LANDMARKS = 40
PURITY = 20.0  # how much more a clean document with a landmark counts than a toxic one
SUPPORT = 0.01  # share of the toxic documents that a landmark must stand in
POWER = 2  # products of kernels are kernels; the second power sets whole words further apart from chance likeness
PIECES = (5, 6, 7, 8)  # lengths of the pieces of words that may become landmarks
LONGEST = 24  # longer words are read in overlapping windows of this length
TRAIN_ROWS = 1000  # bound of the labelled documents of each class that the model is fitted on
TRAIN_TASKS = 16  # parts that these documents are read in
BEST = 4000  # pieces that landmarks are chosen from
REMEMBERED = 200_000
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
SPELLED = re.compile(r"(?:(?<!\S)\w[^\w\s]?\s+){2,}\w(?!\w)")  # letters set apart by blanks


def marked(token: str) -> str:
    """A word between marks, so that its beginning and end count as characters too."""
    return f"^{EDGE.sub('', token)}$"


def letters(words: list[str], fill: int) -> np.ndarray:
    """Code points, one row per word, filled up to the longest."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), size.max(initial=0)), fill, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return out


def meeting(text: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows with a common subsequence of ``ORDER`` characters; all others have a kernel of 0.

    Longest common subsequences of all pairs at once: bit j of a pair's state falls when the landmark's character j extends one.
    """
    known = np.unique(codes[codes >= 0])
    bits = (1 << np.arange(codes.shape[1], dtype=np.uint32)).astype(np.uint32)
    holds = np.zeros((len(known) + 1, len(codes)), np.uint32)  # the last row is for characters of no landmark
    for k, c in enumerate(known):
        holds[k] = ((codes == c) * bits).sum(axis=1, dtype=np.uint32)
    place = np.minimum(np.searchsorted(known, text), max(0, len(known) - 1))
    place = np.where(known[place] == text, place, len(known)) if len(known) else np.zeros(text.shape, np.int64)
    state = np.full((len(text), len(codes)), 0xFFFFFFFF, np.uint32)
    for i in range(text.shape[1]):
        hit = state & holds[place[:, i]]
        state = (state + hit) | (state - hit)
    length = np.bitwise_count(~state & np.uint32((1 << codes.shape[1]) - 1))
    return np.nonzero(length >= ORDER)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Subsequence kernel of every word with every landmark (of up to 31 characters)."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words or not landmarks:
        return out
    all_text, all_codes = letters(words, -1), letters(landmarks, -2)
    row, col = meeting(all_text, all_codes)
    text, codes = np.ascontiguousarray(all_text[row].T), np.ascontiguousarray(all_codes[col].T)
    width, n = len(codes), len(row)
    # inner[p][j]: subsequences of p characters within the word so far and the first j characters of the landmark, weighted to their ends
    inner = [[np.full(n, 1.0 if p == 0 else 0.0, np.float32) for _ in range(width + 1)] for p in range(ORDER)]
    total = np.zeros(n, np.float32)
    for i in range(len(text)):
        same = (text[i] == codes).astype(np.float32)
        for p in range(min(ORDER - 1, i), -1, -1):  # p characters need as many before them, in the word and in the landmark
            running = np.zeros(n, np.float32)
            for j in range(p, width):
                step = inner[p][j] * same[j]
                step *= DECAY * DECAY
                if p == ORDER - 1:
                    total += step
                else:
                    running *= DECAY
                    running += step
                    inner[p + 1][j + 1] *= DECAY
                    inner[p + 1][j + 1] += running
    out[row, col] = total
    return out


class Model:
    """Landmarks, their own kernel values, the weights over them, and the calibration of the decision value."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        own = kernel(landmarks, landmarks)
        self.scale = np.maximum(np.diag(own), 1e-12).astype(np.float32)
        near = (own / np.sqrt(np.outer(self.scale, self.scale))) ** POWER
        values, vectors = np.linalg.eigh((near + near.T) / 2)
        self.whiten = vectors / np.sqrt(np.maximum(values, 1e-2))
        self.weights, self.bias, self.slope, self.shift = np.zeros(len(landmarks)), 0.0, 1.0, 0.0

    def similar(self, words: list[str]) -> np.ndarray:
        """Powers of the kernel values as shares of the landmark's own, at most 1."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        windows = [(k, w[s : s + LONGEST]) for k, w in enumerate(words) for s in range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2)]
        windows.sort(key=lambda x: len(x[1]))
        for start in range(0, len(windows), 1024):
            part = windows[start : start + 1024]
            np.maximum.at(out, [k for k, _ in part], np.minimum(kernel([w for _, w in part], self.landmarks) / self.scale, 1.0) ** POWER)
        return out

    def decide(self, sentences: np.ndarray) -> np.ndarray:
        return sentences @ (self.whiten @ self.weights) + self.bias

    def probability(self, decided: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decided + self.shift, -500, 500)))


class Reader:
    """Turns texts into sentence vectors; the words of earlier texts are remembered up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.values = np.zeros((0, len(model.landmarks)), np.float32)
        self.ends = np.zeros(0, bool)

    def _learn(self, tokens: list[list[str]]) -> None:
        new = list({t for ts in tokens for t in ts if t not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list({t for ts in tokens for t in ts})
        if new:
            have, need = len(self.known), len(self.known) + len(new)
            if need > len(self.ends):
                room = max(need, 2 * len(self.ends))
                self.values = np.concatenate([self.values[:have], np.zeros((room - have, len(self.model.landmarks)), np.float32)])
                self.ends = np.concatenate([self.ends[:have], np.zeros(room - have, bool)])
            self.values[have:need] = self.model.similar([marked(t) for t in new])
            self.ends[have:need] = np.fromiter((t[-1] in ".!?" for t in new), bool, len(new))
            self.known |= {t: have + k for k, t in enumerate(new)}

    def sentences(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text one row per sentence; a text without words has one row of zeros."""
        tokens = []
        for text in texts:
            low = (text or "").lower()
            words = low.split()
            # letters set apart are read together too, each such run as a sentence
            words += ["".join(c for c in m.group() if c.isalnum()) + "." for m in SPELLED.finditer(low)]
            tokens.append(words)
        self._learn(tokens)
        out = []
        for words in tokens:
            if not words:
                out.append(np.zeros((1, len(self.model.landmarks)), np.float32))
                continue
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            starts = np.flatnonzero(np.concatenate([[True], self.ends[at[:-1]]]))
            out.append(np.maximum.reduceat(self.values[at], starts, axis=0))
        return out


def pieces(text: str | None) -> set[str]:
    words = {marked(t) for t in (text or "").lower().split()}
    return {w[s : s + n] for w in words for n in PIECES for s in range(max(0, len(w[:LONGEST]) - n + 1))}


def spread(bags: list[set[str]], found: dict[str, int], n_toxic: int, n_clean: int, most: int) -> list[str]:
    """Of the toxic documents' pieces, each next one for documents that the earlier ones leave out; ``found`` counts clean documents."""
    chosen: list[str] = []
    while len(chosen) < most:
        before, open_ = len(chosen), bags
        while open_ and len(chosen) < most:
            seen = Counter(p for ps in open_ for p in ps)
            seen = {p: n for p, n in seen.items() if not any(p in c or c in p for c in chosen)}
            if not seen:
                break
            top = min(seen, key=lambda p: (PURITY * found[p] / n_clean - seen[p] / n_toxic, -len(p), p))
            chosen.append(top)
            open_ = [ps for ps in open_ if top not in ps]
        if len(chosen) == before:
            break
    return chosen or ["aaaa"]


def choose_landmarks(texts: list[str], toxic: list[int], most: int) -> list[str]:
    """Pieces of words that set the toxic documents apart."""
    n_toxic, n_clean = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    inside, clean = Counter(), Counter()
    for t, y in zip(texts, toxic):
        (inside if y else clean).update(pieces(t))
    # what a piece finds among the toxic documents must outweigh by far what it finds among the clean ones
    worth = {p: n / n_toxic - PURITY * clean[p] / n_clean for p, n in inside.items() if n >= max(2, SUPPORT * sum(toxic))}
    best = set(sorted((p for p in worth if worth[p] > 0), key=lambda p: (-worth[p], -len(p), p))[:BEST])
    return spread([pieces(t) & best for t, y in zip(texts, toxic) if y], clean, n_toxic, n_clean, most)


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 1000.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    rows = np.hstack([x, np.ones((len(x), 1))])
    sign, w = np.where(y, 1.0, -1.0), np.zeros(rows.shape[1])
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    keep = np.diag(np.r_[np.ones(x.shape[1]), 1e-6])
    for _ in range(50):
        inside = sign * (rows @ w) < 1
        part, weight = rows[inside], cost * share[inside] / len(y)
        new = np.linalg.solve(keep + part.T @ (part * weight[:, None]), part.T @ (weight * sign[inside]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 4) -> Model:
    """Fit on labelled documents. Without both classes every score is the share of toxic rows, 0 where there are none."""
    reader = Reader(model := Model(choose_landmarks(texts, toxic, landmarks)))
    bags = [s for k in range(0, len(texts), 64) for s in reader.sentences(texts[k : k + 64])]
    return _fitted(model, np.array(toxic, bool), lambda m: np.array([_worst(b, m) for b in bags]), rounds)


def _worst(bag: np.ndarray, model: Model | None) -> np.ndarray:
    """The sentence that the model rates highest, before there is one the sentence most like a landmark."""
    return bag[(bag.max(axis=1) if model is None else model.decide(bag)).argmax()]


def _fitted(model: Model, y: np.ndarray, worst_by: Callable[[Model | None], np.ndarray], rounds: int = 4) -> Model:
    if not y.any() or y.all():
        model.slope, model.shift = 0.0, 500.0 if y.any() else -500.0
        return model
    worst = worst_by(None)
    for _ in range(rounds):
        model.weights, model.bias = _machine(worst @ model.whiten, y)
        worst = worst_by(model)
    decided = model.decide(worst)
    # calibration: the steepness of a logistic curve through the machine's own boundary
    slope = 1.0
    aim = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * decided, -30, 30)))
        step = ((weight * (p - aim) * decided).sum() + 1e-4 * slope) / ((weight * p * (1 - p) * decided * decided).sum() + 1e-4)
        slope = min(max(slope - step, 0.1), 20.0)
    model.slope = float(slope)
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` distinct labelled texts of each class: ``_no`` (from 1), ``_label``, ``_text``.

    Identifiers are chosen by hash among those whose crc32 is not 0 modulo ``folds``. Where several texts share one, no identifier gives a
    second text before all have given their first, so a hot one fills no more than what the others leave.
    """
    rated = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").alias("_label")).where("_id is not null and _label in (0, 1)").where(~held_out("_id", folds))
    ordered = lambda y: rated.where(F.col("_label") == y).distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
    chosen = cut(ordered(1).unionByName(ordered(0)))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id").withColumn("_key", F.sha2("_text", 256))
    # only identifiers and digests are ranked; a hot identifier's are cut down to ``rows`` before they are shuffled
    turn = F.row_number().over(Window.partitionBy("_label", "_id").orderBy("_key"))
    keys = cut(texts.select("_label", "_id", "_key").distinct()).withColumn("_turn", turn).where(F.col("_turn") <= rows)
    first = lambda y: keys.where(F.col("_label") == y).orderBy("_turn", F.xxhash64("_id"), "_id", "_key").limit(rows)
    kept = first(1).unionByName(first(0)).drop("_turn")
    kept = cut(kept.withColumn("_no", F.row_number().over(Window.orderBy("_label", "_id", "_key"))))  # at most 2 * rows
    taken = texts.join(F.broadcast(kept), ["_label", "_id", "_key"]).groupBy("_no", "_label").agg(F.first("_text").alias("_text"))
    return cut(taken.repartition(TRAIN_TASKS, "_no"))


def _piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, clean = Counter(), Counter()

    def told() -> pa.RecordBatch:
        names = list(inside.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[p] for p in names], pa.int64()) for c in (inside, clean))], names=["_piece", "_toxic", "_clean"])

    for batch in batches:
        for y, text in zip(*(c.to_pylist() for c in batch.columns)):
            (inside if y else clean).update(pieces(text))
            if len(inside) + len(clean) > REMEMBERED:
                yield told()
                inside.clear(), clean.clear()
    yield told()


def _landmarks(rows: DataFrame, n_toxic: int, n_clean: int, most: int) -> list[str]:
    """``choose_landmarks`` over a table of labelled texts: pieces are counted in tasks, and the driver gets the best ones alone."""
    counted = rows.select("_label", "_text").mapInArrow(_piece_counts, "_piece string, _toxic bigint, _clean bigint").groupBy("_piece").agg(F.sum("_toxic").alias("_toxic"), F.sum("_clean").alias("_clean"))
    worth = F.col("_toxic") / max(1, n_toxic) - F.lit(PURITY) * F.col("_clean") / max(1, n_clean)
    useful = counted.where(F.col("_toxic") >= max(2, SUPPORT * n_toxic)).withColumn("_worth", worth).where("_worth > 0")
    best = useful.orderBy(F.desc("_worth"), F.desc(F.length("_piece")), "_piece").limit(BEST).collect()
    found = {r._piece: r._clean for r in best}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(found.keys() & pieces(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], names=["_pieces"])

    bags = [set(r._pieces) for r in rows.where("_label = 1").select("_text").mapInArrow(held, "_pieces array<string>").collect()]
    return spread(bags, found, max(1, n_toxic), max(1, n_clean), most)


def _bags(model: Model):
    """The distinct sentence vectors of every text, in order of appearance."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            packed = []
            for text in batch.column(1).to_pylist():
                bag = reader.sentences([text])[0]
                packed.append(bag[np.sort(np.unique(bag, axis=0, return_index=True)[1])].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["_no", "_bag"])

    return read


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5, rows: int = TRAIN_ROWS) -> Model:
    """Fit on the ``sample``. Texts are read in tasks; the driver gets one sentence vector a text and round."""
    texts = sample(docs, labels, id_col, text_col, label, folds, rows)
    y = np.array([r._label for r in texts.select("_no", "_label").orderBy("_no").collect()], int) == 1
    model = Model(_landmarks(texts, int(y.sum()), int((~y).sum()), LANDMARKS))
    bags = cut(texts.select("_no", "_text").mapInArrow(_bags(model), "_no int, _bag binary"))

    def worst_by(now: Model | None) -> np.ndarray:
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = [_worst(np.frombuffer(b, np.float32).reshape(-1, len(model.landmarks)), now).tobytes() for b in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.binary())], names=["_no", "_worst"])

        got = sorted(bags.mapInArrow(pick, "_no int, _worst binary").collect(), key=lambda r: r._no)
        return np.array([np.frombuffer(r._worst, np.float32) for r in got])

    return _fitted(model, y, worst_by)


def held_out(id_col: str, folds: int = 5):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(folds)) == 0


_readers: dict[tuple[str, ...], Reader] = {}


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (landmarks := tuple(model.landmarks)) not in _readers:  # a worker keeps the last reader over its tasks
            _readers.clear()
            _readers[landmarks] = Reader(model)
        reader = _readers[landmarks]
        for batch in batches:
            scores: list[float] = []
            for start in range(0, batch.num_rows, 64):
                bags = reader.sentences(batch.column(batch.num_columns - 1).slice(start, 64).to_pylist())
                scores += [float(model.probability(model.decide(b).max())) for b in bags]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "_score"])

    return score


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``_score`` (0 to 1, higher is more likely toxic).

    Null and empty texts, and texts without words, score as a sentence that resembles no landmark. Rows are scored one by one, from
    their text alone; an empty table gives an empty result; further columns aren't read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(_scorer(model), f"_id {rows.schema['_id'].dataType.simpleString()}, _score double")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", line: float = 0.5) -> DataFrame:
    """The documents that score below ``line``, with the columns they came with."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    schema = StructType([kept.schema["_row"], StructField("_score", DoubleType())])
    passed = kept.mapInArrow(_scorer(model), schema).where(F.col("_score") < line)
    return passed.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
