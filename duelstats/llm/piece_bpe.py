"""SentencePiece encoding and decoding: byte-pair merges in vectorised rounds.

Texts are cut at blanks into words, and a batch's words are told apart in Arrow, so every different word is merged once; a worker
remembers words up to a bound. New words lie side by side in one flat array of symbols:

1. A word is cut further wherever no piece holds the two characters on both sides, so no merge can reach across.
2. A round looks up the rank of every two neighbouring symbols, takes the least rank of each word (segmented minimum) and merges
   its places from left to right, then closes the gaps. Words without a pair left leave the array.
3. A merge can open a better or equally ranked pair with a neighbour, and that one has to come before the places further right. So a
   round stops in a word at the first place where this happens, and the result is that of one merge at a time.
4. Characters without a piece become their UTF-8 bytes.

Decoding gathers the strings of the identifiers and joins them by document in Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from duelstats.llm.token_counts import slices

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: the library's kinds of pieces
REMEMBERED = 400_000  # words
TOGETHER = 1 << 18  # characters that are merged at a time
NEVER = np.iinfo(np.int32).max
SLOTS = 19  # hash tables of 2**SLOTS pairs
MULTIPLIERS = np.random.default_rng(5).integers(1 << 62, 1 << 63, 8, np.int64).astype(np.uint64) | np.uint64(1)


class Pieces:
    """A byte-pair model as arrays: symbols of characters, pairs with what they make, and strings for decoding.

    Raises ``ValueError`` for models that normalise texts or hold kinds of pieces this reader doesn't know.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models that leave texts as they are")
        if {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE} or not model.trainer_spec.byte_fallback:
            raise ValueError("only normal, control and byte pieces, and all bytes")
        self.prefix = spec.add_dummy_prefix
        self.count = len(model.pieces)
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == model.trainer_spec.eos_piece)
        self.normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes_at = np.array([next(i for i, p in enumerate(model.pieces) if p.piece == f"<0x{b:02X}>" and p.type == BYTE) for b in range(256)], np.int64)
        # equal scores share a rank; less is better
        scores = np.array([-model.pieces[i].score for i in self.normal.values()])
        order = np.unique(scores, return_inverse=True)[1]
        rank = np.full(self.count, NEVER, np.int64)
        rank[list(self.normal.values())] = order
        self._characters()
        self._pairs(rank)
        said = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else model.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        self.said = pa.array(said + [t.removeprefix(b" ") for t in said], pa.large_binary())  # then each without its blank
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.is_control = np.array([p.type == CONTROL for p in model.pieces])
        self.opens_blank = np.array([p.type == NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        self.numbers = pa.array([str(i) for i in range(self.count)])

    def _characters(self) -> None:
        """Symbols of characters (a character that only longer pieces hold gets a number past the pieces), and neighbours within pieces."""
        singles = {c: self.normal.get(c) for p in self.normal for c in p}
        extra = iter(range(self.count, self.count + len(singles)))
        self.symbol = {c: i if i is not None else next(extra) for c, i in singles.items()}
        self.unknown = self.count + len(singles)  # characters of no piece
        self.symbol_at = np.full(0x110000, self.unknown, np.int32)
        self.symbol_at[[ord(c) for c in self.symbol]] = list(self.symbol.values())
        # neighbours within pieces, as a table over the characters that have any
        beside = {(a, b) for p in self.normal for a, b in zip(p, p[1:])}
        met = {c: k for k, c in enumerate(sorted({c for ab in beside for c in ab}), 1)}
        self.met_at = np.zeros(0x110000, np.int16)
        self.met_at[[ord(c) for c in met]] = list(met.values())
        self.beside = np.zeros((len(met) + 1, len(met) + 1), bool)
        for x, y in beside:
            self.beside[met[x], met[y]] = True
        self.longest = max(map(len, self.normal))
        self.blanks = max((len(p) for p in self.normal if not p.strip(BLANK)), default=1)

    def _pairs(self, rank: np.ndarray) -> None:
        known = self.symbol | {p: i for p, i in self.normal.items() if len(p) > 1}
        made = [(known[p[:k]], known[p[k:]], i) for p, i in self.normal.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        left, right, piece = np.array(made, np.int64).reshape(-1, 3).T
        self.width = self.unknown + 1
        self.makes = np.r_[piece, 0]
        self.rank = np.r_[rank[piece], NEVER].astype(np.int32)
        self._lay(left * self.width + right)
        part = np.full(self.width, NEVER, np.int64)  # the best rank of a piece that one more symbol makes of this one
        np.minimum.at(part, left, rank[piece])
        np.minimum.at(part, right, rank[piece])
        self.alone = part[: self.count] <= rank

    def _lay(self, key: np.ndarray) -> None:
        """Hash tables of the pairs; what finds its place taken goes to the next table."""
        self.tables, left = [], np.arange(len(key))
        while len(left):
            slot = self._slot(key[left], len(self.tables))
            keys, at = np.full(1 << SLOTS, -1, np.int64), np.full(1 << SLOTS, len(key), np.int32)
            keys[slot], at[slot] = key[left], left
            self.tables.append((keys, at))
            left = left[at[slot] != left]

    def _slot(self, key: np.ndarray, table: int) -> np.ndarray:
        return ((key.astype(np.uint64) * MULTIPLIERS[table % len(MULTIPLIERS)]) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER for none) of neighbouring symbols, and the number of the pair."""
        key = a.astype(np.int64) * self.width + b
        pair = np.full(len(key), len(self.rank) - 1, np.int32)
        for table, (keys, at) in enumerate(self.tables):
            slot = self._slot(key, table)
            pair = np.where(keys[slot] == key, at[slot], pair)
        return self.rank[pair], pair

    def _draws(self, symbol, part, hit, made, after: np.ndarray) -> np.ndarray:
        """Whether a new symbol and a neighbour make a piece that comes before what is left; ``after`` marks places right behind another one."""
        rank = self.look_up(symbol[hit], symbol[hit + 1])[0]
        left, right = np.maximum(hit - 1, 0), np.minimum(hit + 2, len(symbol) - 1)
        before = np.where(after, made, symbol[left])
        to_left = (part[left] == part[hit]) & (left < hit) & (self.look_up(before, made)[0] <= rank)
        return to_left | ((part[right] == part[hit]) & (right > hit + 1) & (self.look_up(made, symbol[right])[0] <= rank))

    def parts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the parts of words begin: no piece holds the characters on both sides, or a long row of blanks has filled its longest piece."""
        kind = self.met_at[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.beside[kind[:-1], kind[1:]]
        cut[starts] = True
        blank = points == ord(BLANK)
        if self.blanks > 1 and blank.any():
            begins = np.flatnonzero(blank & np.r_[True, ~blank[:-1] | cut[1:]])
            ends = np.flatnonzero(blank & np.r_[~blank[1:] | cut[1:], True]) + 1
            for a, b in zip(begins.tolist(), ends.tolist()):
                cut[a : max(a, b - self.blanks) : self.blanks] = True  # a row's last blank may belong to the word behind it
        return np.flatnonzero(cut)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all words one after another, and how many each word has. No word is empty."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(length) - length
        symbol = self.symbol_at[points]
        place = np.arange(len(points), dtype=np.int32)  # where a symbol's first character stands
        part = np.zeros(len(points), np.int32)
        part[self.parts(points, starts)[1:]] = 1
        part = np.cumsum(part, dtype=np.int32)
        done = []
        while len(symbol):
            rank, pair = np.full(len(symbol), NEVER, np.int32), np.zeros(len(symbol), np.int32)
            inside = np.flatnonzero(part[1:] == part[:-1])
            rank[inside], pair[inside] = self.look_up(symbol[inside], symbol[inside + 1])
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(symbol)])
            open_ = np.repeat(best < NEVER, sizes)
            if not open_.all():
                done.append((place[~open_], symbol[~open_]))
                symbol, place, part, rank, pair = (x[open_] for x in (symbol, place, part, rank, pair))
                best, sizes = best[best < NEVER], sizes[best < NEVER]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            home, made = part[hit], self.makes[pair[hit]]
            leads = np.r_[True, home[1:] != home[:-1]]  # the leftmost place of its word
            # of places that overlap in a row every other one, from the left
            joined = np.r_[False, ~leads[1:] & (hit[1:] == hit[:-1] + 1)]
            row = np.flatnonzero(~joined)
            nth = np.arange(len(hit)) - np.repeat(row, np.diff(np.r_[row, len(hit)]))
            hit, home, made = (x[nth % 2 == 0] for x in (hit, home, made))
            leads = np.r_[True, home[1:] != home[:-1]]
            draws = self.alone[made] & self._draws(symbol, part, hit, made, ~leads & np.r_[False, hit[1:] == hit[:-1] + 2])
            # up to the first place of a word whose neighbours come next, and from one that no other can reach
            begins = np.flatnonzero(leads | (np.r_[0, np.diff(place[hit])] > 4 * self.longest))
            drawn = np.cumsum(draws) - draws
            take = drawn == np.repeat(drawn[begins], np.diff(np.r_[begins, len(hit)]))
            symbol[hit[take]] = made[take]
            keep = np.ones(len(symbol), bool)
            keep[hit[take] + 1] = False
            symbol, place, part = symbol[keep], place[keep], part[keep]
        place, symbol = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        order = np.empty(len(points), np.int32)
        order[place] = np.arange(len(place), dtype=np.int32)
        held = np.zeros(len(points), bool)
        held[place] = True
        order = order[held]  # by place
        place, symbol = place[order], symbol[order]
        return self._spell(points, starts, place, symbol)

    def _spell(self, points, starts, place, symbol) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as bytes; identifiers by word."""
        at = np.zeros(len(points), np.int32)
        at[starts] = 1
        word = np.cumsum(at, dtype=np.int32)[place] - 1
        odd = np.flatnonzero(symbol >= self.count)
        if len(odd):
            raw = [chr(p).encode() for p in points[place[odd]].tolist()]
            many = np.ones(len(symbol), np.int64)
            many[odd] = [len(r) for r in raw]
            is_odd = np.repeat(symbol >= self.count, many)
            word, symbol = np.repeat(word, many), np.repeat(symbol, many)
            symbol[is_odd] = self.bytes_at[np.frombuffer(b"".join(raw), np.uint8)]
        return symbol.astype(np.int32), np.bincount(word, minlength=len(starts))


_models: dict[str, Pieces] = {}


def pieces(name: str) -> Pieces:
    """The model of a vocabulary file, read once per worker."""
    if name not in _models:
        import public_tokenizers

        _models[name] = Pieces(public_tokenizers.path(name))
    return _models[name]


class Encoder:
    """Identifiers of texts by their words, which are remembered: ``flat`` holds them one after another."""

    def __init__(self, model: Pieces):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.many = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str], flat: np.ndarray, many: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(many) - many]
        self.flat, self.many = np.r_[self.flat, flat], np.r_[self.many, many]

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """Identifiers of the words with these numbers."""
        many = self.many[at]
        return self.flat[np.repeat(self.start[at] - np.cumsum(many) + many, many) + np.arange(many.sum())]

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of different words, new ones merged. When there are too many, only these words stay."""
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        if len(self.known) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            old = np.flatnonzero(at >= 0)
            flat, many = self._gather(at[old]), self.many[at[old]]
            self._forget()
            self._learn([words[k] for k in old.tolist()], flat, many)
            at[old] = np.arange(len(old))
        new = [words[k] for k in np.flatnonzero(at < 0).tolist()]
        at[at < 0] = len(self.known) + np.arange(len(new))
        edges = (np.flatnonzero(np.diff(np.cumsum([len(w) for w in new]) // TOGETHER)) + 1).tolist() if new else []
        done = [self.model.merge(new[a:b]) for a, b in zip([0, *edges], [*edges, len(new)]) if b > a]
        if done:
            self._learn(new, *(np.concatenate(x) for x in zip(*done)))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts (none null), an end identifier behind each, and how many each text has."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        texts = pc.replace_substring(texts, BLANK, " ")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts, " ")
        offset = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # a word takes along the blanks before it, a text's last blanks are a word of their own
        closes = np.fromiter(map(bool, words), bool, len(words))[code]
        closes[offset[1:] - 1] = True
        at = np.flatnonzero(closes)
        blanks = np.diff(np.r_[-1, at])  # one before every split word
        text = np.repeat(np.arange(len(texts)), np.add.reduceat(closes, offset[:-1], dtype=np.int64))
        if not self.model.prefix:
            blanks[np.r_[True, text[1:] != text[:-1]]] -= 1
        blanks[size[text] == 0] = 0
        # different words: most have one blank, and their code tells them apart
        key = blanks * len(words) + code[at]
        plain = blanks == 1
        seen = np.zeros(len(words), bool)
        seen[code[at[plain]]] = True
        used = np.r_[np.flatnonzero(seen) + len(words), np.unique(key[~plain])]
        spelled = [BLANK * (k // len(words)) + words[k % len(words)] for k in used.tolist()]
        numbers = np.full(len(used), -1)
        some = np.fromiter(map(bool, spelled), bool, len(spelled))
        numbers[some] = self._numbers([w for w in spelled if w])
        of_code = np.zeros(len(words), np.int64)
        of_code[seen] = numbers[: seen.sum()]
        number = of_code[code[at]]
        number[~plain] = numbers[seen.sum() + np.searchsorted(used[seen.sum() :], key[~plain])]
        text, number = text[number >= 0], number[number >= 0]
        total = np.bincount(text, self.many[number], len(texts)).astype(np.int64)
        out = np.full(total.sum() + len(texts), self.model.end, np.int32)
        said = np.ones(len(out), bool)
        said[np.cumsum(total + 1) - 1] = False
        out[said] = self._gather(number)
        return out, total + 1


def decode(model: Pieces, ids: np.ndarray, many: np.ndarray) -> pa.Array:
    """Texts of identifiers, ``many`` of them for each text.

    Control identifiers say nothing, the first blank that the encoder put before a text goes, and bytes that are no UTF-8 become
    U+FFFD one by one, as the library does.
    """
    if len(ids) and (ids.min() < 0 or ids.max() >= model.count):
        raise ValueError("identifiers out of range")
    offset = np.r_[0, np.cumsum(many)]
    # the first piece that says something decides on the blank
    speaks = np.flatnonzero(~model.is_control[ids])
    first = np.searchsorted(speaks, offset[:-1])
    lead = speaks[np.minimum(first, max(len(speaks) - 1, 0))] if len(speaks) else np.zeros(len(many), np.int64)
    has = (first < len(speaks)) & (lead < offset[1:]) if len(speaks) else np.zeros(len(many), bool)
    drop = np.zeros(len(many), bool)
    if model.prefix:
        drop[has] = model.opens_blank[ids[lead[has]]]
    spoken = ids.astype(np.int64)
    spoken[lead[drop]] += model.count
    said = model.said.take(pa.array(spoken))
    whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offset, pa.int64()), said), pa.scalar(b"", pa.large_binary()))
    held = np.r_[0, np.cumsum(model.is_byte[ids])]
    odd = held[offset[1:]] > held[offset[:-1]]
    if not odd.any():
        return whole.cast(pa.large_string())
    texts = []
    for raw, a, b, gone in zip(whole.to_pylist(), offset[:-1].tolist(), offset[1:].tolist(), drop.tolist()):
        try:
            texts.append(raw.decode())
        except UnicodeDecodeError:
            texts.append(_by_runs(model, ids[a:b], gone))
    return pa.array(texts, pa.large_string())


def _by_runs(model: Pieces, ids: np.ndarray, drop: bool) -> str:
    """A text whose bytes are no UTF-8: each run of bytes is read by itself, every byte that fits nowhere as U+FFFD."""
    out, run = [], bytearray()
    for i in [*ids.tolist(), -1]:
        if i >= 0 and model.is_byte[i]:
            run += model.said[i].as_py()
            continue
        while run:
            try:
                out.append(run.decode())
                run.clear()
            except UnicodeDecodeError as bad:
                out.append(run[: bad.start].decode() + "�")
                del run[: bad.start + 1]
        if i >= 0:
            out.append(model.said[i].as_py().decode())
    return "".join(out)[drop:]


_encoders: dict[str, Encoder] = {}


def _round_trip(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(name, Encoder(pieces(name)))  # a worker keeps its words over its tasks
        for batch in batches:
            texts, passed = pc.fill_null(batch.column(1), ""), 0
            for part in slices(texts):
                ids, many = encoder.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(passed, len(part)),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(ids, pa.int32())),
                        decode(encoder.model, ids, many).cast(pa.string()),
                    ],
                    names=["_id", "_ids", "_decoded"],
                )
                passed += len(part)

    return run


def round_trip(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``_ids`` (identifiers with the end identifier behind them) and ``_decoded`` (their text again).

    Null and empty texts have the end identifier alone and decode to the empty text. Rows are encoded one by one, so repeated rows and
    identifiers change nothing; an empty table gives an empty result, and further columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_round_trip(vocabulary), f"_id {kind}, _ids array<int>, _decoded string")


def _decoded(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            many = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(lists.flatten(), model.end).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), decode(model, ids, many).cast(pa.string())], names=["_id", "_decoded"])

    return run


def decoded(rows: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of given lists of identifiers, as ``_id`` and ``_decoded``; a null list counts as empty, a null within one says nothing."""
    lists = rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("_ids"))
    kind = lists.schema["_id"].dataType.simpleString()
    return lists.mapInArrow(_decoded(vocabulary), f"_id {kind}, _decoded string")
