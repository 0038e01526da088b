"""Small fixtures with odd rows, and brute-force twins where SQL has no words for an operator."""

import hashlib
import io
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from duelstats.llm import content_sort, importance, mixing, near_dedup, periodic_runs, phrase_index, piece_bpe, randomness, spelling, suffix_buckets, token_counts, toxicity, warc
from duelstats.llm.tokens import Hashes

SCHEMA = "doc_id bigint, text string, source string, _text string, _doc string"  # the last two clash with names used inside
LONG = " ".join(f"w{i * 7919 % 977}" for i in range(600))
PASSAGE = " ".join(f"p{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, None, "x", "y"), (2, "", "a", None, None), (3, LONG, "a", None, None), (4, LONG, "b", None, None), (4, LONG, "b", None, None)]
    rows += [(5, LONG.replace("w0 ", "changed ", 1), "b", None, None), (6, "one " + PASSAGE + " end", "c", None, None), (7, "other " + PASSAGE, "c", None, None)]
    rows += [(None, "tie", None, None, None), (None, "tie", None, None, None), (8, "naïve ööö 日本 🙂 " * 40, "c", None, None), (9, "!!! ???", "c", None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeated_strings(docs, empty):
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
    want = []
    for doc, b in texts:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                mask[i : i + 200] = True
        runs = int((np.diff(np.r_[False, mask].astype(int)) == 1).sum())
        want.append((str(doc), len(b), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    got = [(str(r._id), r._bytes, r._removed, r._spans, r._sha) for r in suffix_buckets.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 0
    assert suffix_buckets.remove_repeats(empty).count() == 0


def test_exact_groups(docs, empty):
    for rows in (1, 1000):  # with and without split groups
        got = content_sort.exact_groups(docs, keep="largest", part_rows=rows).collect()
        assert Counter((r._size, r._kept) for r in got if r._keep_id == 4) == {(3, False): 2, (3, True): 1}
        assert sum(r._kept for r in got) == len({r.text or "" for r in docs.collect()}) and len(got) == docs.count()
    assert content_sort.exact_dedup(docs).columns == docs.columns
    assert content_sort.exact_dedup(empty).count() == 0


def test_near_groups(docs, empty):
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == docs.count()
    by = {r._id: r for r in got if r._id is not None}
    assert by[3]._class == by[4]._class == by[5]._class == 3 and by[3]._size == 4
    assert by[1]._size == by[2]._size == by[9]._size == 1
    assert sum(r._stays for r in got) == len({r._group for r in got})
    assert near_dedup.without_near(docs).columns == docs.columns
    assert near_dedup.near_groups(empty).count() == 0


def test_sampling_follows_weighted_jaccard():
    rng, known = np.random.default_rng(1), Hashes()
    words = [f"v{i}" for i in rng.integers(0, 10_000, 800)]
    other = words[:400] + [f"z{i}" for i in range(400)]
    rare = np.ones(near_dedup.SKETCH, np.float32)
    (fa, ca), (fb, cb) = near_dedup.shingles(words, known), near_dedup.shingles(other, known)
    share = len(np.intersect1d(fa, fb)) / len(np.union1d(fa, fb))
    hits = []
    for seed in range(20):
        sampler = near_dedup.Sampler(seed)
        a, b = (sampler.bands(f, near_dedup.weights(f, c, rare)) for f, c in ((fa, ca), (fb, cb)))
        hits.append((a == b).mean())
    assert abs(np.mean(hits) - share**near_dedup.ROWS) < 0.05


def test_near_verdict_ignores_collisions(spark):
    """Two documents of similarity 0.795, and so many other shingles that every counter of the search's sketch is taken."""
    passage = [f"p{i}" for i in range(1000)]
    rows = [(k, " ".join(passage + [f"q{k}x{i}" for i in range(95)])) for k in (1, 2)]
    rows += [(k, " ".join(passage + [f"q{k}x{i}" for i in range(2000)])) for k in range(3, 61)]
    rows += [(k, " ".join(f"{k * 80_000 + i}" for i in range(75_000))) for k in range(61, 101)]
    table = spark.createDataFrame(rows, "doc_id int, text string").repartition(8)
    got = {r._id: r._size for r in near_dedup.near_groups(table).collect()}
    assert len(got) == 100 and got[1] == got[2] == 1


def test_near_groups_compare_few_pairs(spark, monkeypatch):
    """Copies of one text with up to five words replaced: most pairs are no links, and all share buckets."""
    rng, base, texts = random.Random(8), [f"b{i}" for i in range(150)], []
    for k in range(240):
        said = list(base)
        for j in range(k % 6):
            said[rng.randrange(150)] = f"e{k}x{j}"
        texts.append(said)
    found = [{tuple(t[i : i + 5]) for i in range(146)} for t in texts]
    df = Counter(g for f in found for g in f)
    weigh = lambda some: sum(near_dedup.rareness(np.array([df[g] for g in some] or [len(texts)]), len(texts))) if some else 0
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if weigh(found[a] & found[b]) >= 0.8 * weigh(found[a] | found[b]):
            group = [group[a] if g == group[b] else g for g in group]
    pairs, cut = [], near_dedup.cut

    def counted(df):
        kept = cut(df)
        if {"_a", "_b", "_far"} <= set(kept.columns) and "_bucket" not in kept.columns:
            pairs.append(kept.count())
        return kept

    monkeypatch.setattr(near_dedup, "cut", counted)
    got = near_dedup.near_groups(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id int, text string").repartition(4)).collect()
    assert Counter(r._size for r in got) == Counter(n for n in Counter(group).values() for _ in range(n))
    assert 0 < sum(pairs) < 4 * len(texts)


def test_words_and_windows_by_plain_means():
    texts = ["", "one Two_three\x1c4 b\x00c\x7fd", "ÄB_ç٣½ 日本🙂x\u2028y\x85z \ufb01", "".join(map(chr, range(0x3000)))]
    for text in texts:
        assert near_dedup.words_of(text) == re.findall(r"[^\W_]+", text.lower())
    data = np.random.default_rng(3).integers(97, 99, 2000).astype(np.uint8)
    data[700:1100] = 97
    h, at = suffix_buckets.chosen(data)
    high = (h >> np.uint64(24)).tolist()
    assert at.tolist() == [min(range(i, i + suffix_buckets.SLIDE), key=lambda k: (high[k], k)) for i in range(len(data) - suffix_buckets.LENGTH + 1)]


def test_words_of_many_texts_are_hashed_together():
    rng = np.random.default_rng(2)
    words = ["a", "b", "ab", "ba", "aab", "aba", "baa", "é", "éa", "0"]
    texts = [" ".join(rng.choice(words, n)).encode() for n in [*range(12), 3000, 9000, 0, 4, 5]]
    every = near_dedup.word_hashes(" ".join(words).encode())
    assert len(set(every.tolist())) == len(words)
    assert near_dedup.word_hashes(b"ba \xc3\xa9 ba a").tolist() == [every[3], every[7], every[3], every[0]]
    got = list(near_dedup.shingled(iter(texts)))
    assert [text for text, _ in got] == texts
    for text, mixes in got:
        found, counts = near_dedup.shingles(text.decode().split())
        assert np.array_equal(np.unique(mixes), found) and counts.sum() == len(mixes)
        own = text.decode().split()
        grams = Counter(tuple(own[i : i + near_dedup.SHINGLE]) for i in range(max(len(own) - near_dedup.SHINGLE, 0) + 1)) if own else {}
        assert sorted(counts.tolist()) == sorted(grams.values())


def test_windows_of_long_texts(monkeypatch):
    data = np.random.default_rng(3).integers(97, 99, 3000).astype(np.uint8)
    whole = suffix_buckets.chosen(data)[1]
    monkeypatch.setattr(suffix_buckets, "BLOCK", 100)
    assert (suffix_buckets.chosen(data)[1] == whole).all()


def test_exact_frequencies(spark, docs):
    known = Hashes()
    rows = [(i, zstandard.compress(" ".join(near_dedup.words_of(r.text)).encode())) for i, r in enumerate(docs.collect()) if near_dedup.words_of(r.text)]
    found = {i: near_dedup.shingles(zstandard.decompress(p).decode().split(" "), known)[0] for i, p in rows}
    seen = Counter(h for f in found.values() for h in f.tolist())
    landed = spark.createDataFrame(rows, "_doc bigint, _packed binary")
    for total in (1, 5 * near_dedup.COUNTED):  # one block and several
        got = near_dedup.with_frequencies(landed, landed.where("_doc > 2").select("_doc"), total).collect()
        assert {r._doc for r in got} == {i for i in found if i > 2}
        for r in got:
            assert np.frombuffer(zstandard.decompress(r._df), np.int64).tolist() == [seen[h] for h in found[r._doc].tolist()]
    assert max(seen.values()) > 2


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, "short one"), (3, None), (4, "tie"), (10, PASSAGE.upper())], "item_id int, text string")
    got = {r._id: r for r in phrase_index.contamination(docs, items).collect()}
    assert (got[6]._n, got[6]._hit, got[6]._item_list, got[6]._contaminated) == (62, 60, ["1", "10"], True)
    assert got[None]._hit == 1 and got[None]._item_list == ["4"] and got[3]._hit == 0 and got[1]._n == 0
    assert phrase_index.contamination(empty, items).count() == 0
    assert phrase_index.contamination(docs, items.limit(0)).where("_contaminated").count() == 0
    mixed = spark.createDataFrame([(20, " ".join(reversed(PASSAGE.split())))], "doc_id bigint, text string")
    index = phrase_index.PhraseIndex(mixed, items.limit(1))
    assert index.spans().count() == 0 and index.near().count() > 0


def test_secrets(spark, empty):
    key = hashlib.sha512(b"k").hexdigest().upper()[:100]
    text = f"🙂 Password: 'abcdef1' token=ab AKIA{'A1' * 8} {'0123456789abcdef' * 2} {key}"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, "plain words only")], "doc_id bigint, text string")
    got = [(r._id, [(s.kind, text[s.start : s.end]) for s in r._spans]) for r in randomness.secrets(rows).collect()]
    first = next(s for i, s in got if s)
    assert [k for k, _ in first][:3] == [0, 1, 2] and first[0][1] == "Password: 'abcdef1" and first[1][1] == f"AKIA{'A1' * 8}"
    assert (3, key) in first and sum(bool(s) for _, s in got) == 1 and len(got) == 4
    assert randomness.secrets(empty).count() == 0


def test_toxicity_kernel_and_scores(docs, empty):
    k = toxicity.kernel(["^idiot$", "^idxiot$", "^garden$"], ["^idiot$"])[:, 0]
    assert k[0] > k[1] > 3 * k[2]
    said = "what a day. you are an {} my man"
    clean = [said.format(w) for w in ("artist", "engineer", "old friend", "early bird", "honest dog", "angel")] * 5
    toxic = [said.format(w) for w in ("idiot", "idiot,", "moron", "moron!")] * 8
    model = toxicity.fit(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    reader = toxicity.Reader(model)
    score = lambda t: float(model.probability(model.decide(reader.sentences([t])[0]).max()))
    assert score("you are an idiot") > 0.5 > score("you are an honest bird") and score("i d i o t") > score("a b c d e")
    got = toxicity.scores(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r._score <= 1 for r in got)
    assert toxicity.without_toxic(docs, model).columns == docs.columns and toxicity.scores(empty, model).count() == 0


def test_toxicity_sample_is_bounded(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    hot, toxic, clean = ids[0], ids[1:4], ids[4:]
    rows = [(hot, f"text {k} says blarghish today") for k in range(500)] * 2 + [(i, f"you are an idiot, number {i}") for i in toxic]
    rows += [(i, f"a fine garden with tree {i}") for i in clean]
    table = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i not in clean)) for i in ids], "doc_id int, toxic int")
    got = toxicity.sample(table, labels, rows=20).collect()
    said = [r._text for r in got if r._label == 1]
    assert len(said) == len(set(said)) == 20 and sum("idiot" in t for t in said) == 3 and len(got) == 40
    model = toxicity.train(table, labels, rows=20)
    score = {r._id: r._score for r in toxicity.scores(table, model).collect()}
    assert min(score[i] for i in toxic) > 0.5 > max(score[i] for i in clean)
    same = toxicity.fit([r._text for r in got], [r._label for r in got])
    assert same.landmarks == model.landmarks and np.allclose(same.weights, model.weights, atol=1e-4)


def test_token_counts(docs, empty):
    made = token_counts.tokenizer("byte_bpe_50k.json")
    odd = docs.sparkSession.createDataFrame([(30, "a  b\n c <|endoftext|> d don't  stop 12 , x"), (31, "x" * 50_000)], "doc_id bigint, text string")
    for table in (docs.select("doc_id", "text"), odd):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(made.encode(r.text or "", add_special_tokens=False).ids)) for r in table.collect())
        assert sorted((str(r._id), r._bytes, r._tokens) for r in token_counts.token_counts(table).collect()) == want
    assert token_counts.token_counts(empty).count() == 0


def test_importance(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1), (6, 1), (8, 0), (None, 1)], "doc_id bigint, quality int")
    got = importance.resample(docs, labels).collect()
    assert len(got) == docs.count() and 0 < sum(r._selected for r in got) <= docs.count()
    assert {r._id: r._weight for r in got}[2] == 0.0
    assert importance.resample(empty, labels).count() == 0


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r._copies <= 3 for r in got)
    assert sum(t for t in {(r._source_size, r._target) for r in got} for t in t[1:]) == pytest.approx(sum(r._size for r in got))
    assert mixing.mix(empty).count() == 0


def _mixed(rows, taken):
    """Words taken per source, beside the target (one value per source)."""
    out = {}
    for r, t in zip(rows, taken):
        entry = out.setdefault(r._source_size, [0, r._target, 0])
        entry[0], entry[2] = entry[0] + t, max(entry[2], r._size)
    return out


@pytest.mark.parametrize("hot", [(7, 3000, "one two three four"), (None, 3000, "one two three four"), (9, 3000, None)])
def test_mix_meets_targets_with_shared_identifiers(spark, hot):
    """Thousands of rows share an identifier: with one text (equal rows), or each with its own."""
    shared, many, text = hot
    rows = [(shared, text or " ".join(["w"] * (k % 9 + 1)) + f" {k}", "a") for k in range(many)]
    rows += [(k, " ".join(["v"] * (k % 7)), "a") for k in range(2000)] + [(k, "x y z " * 5, "b") for k in range(800)] + [(k, "q " * (k % 40), "c") for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    got = mixing.mix(table).collect()
    assert len(got) == len(rows) and all(0 <= r._copies <= 3 for r in got)
    for words, target, longest in _mixed(got, [r._size * r._copies for r in got]).values():
        assert abs(words - target) <= longest
    again = mixing.mix(table.repartition(3)).collect()
    assert Counter((r._id, r._size, r._copies) for r in again) == Counter((r._id, r._size, r._copies) for r in got)


def test_importance_keeps_its_budget_and_the_best_draws(spark):
    rows = [(5, "good words here")] * 3000 + [(k, f"text {k} of {k % 13} kinds") for k in range(2000)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(0, 2000, 3)], "doc_id bigint, quality int")
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for share in (0.6, 0.1, 0.0, 1.0):
        got = importance.resample(table, labels, share=share).collect()
        chosen, left = [r._draw for r in got if r._selected], [r._draw for r in got if not r._selected]
        assert len(chosen) == round(share * len(rows)) and len(got) == len(rows)
        # the largest draws: keys are cut to 48 bits, so the smallest chosen one may lie a rounding below
        assert not chosen or not left or min(chosen) >= max(left) - 1e-3


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (2, "http://c d\r\n", "same"), (3, "http://e", None), (4, "http://f", ""), (None, "g", "same"), (5, "h", "ö" * 300_000)]
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert got == sorted([("1", 4, "revisit", 2), ("2", 4, "response", None), ("2", 4, "response", None), ("3", 0, "revisit", 4), ("4", 0, "response", None), ("None", 4, "revisit", 2), ("5", 600_000, "response", None)])
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_identifiers_stay_exact(spark):
    big = 1 << 60
    rows = [(big + 1, "same"), (big + 2, "same"), (big + 3, "other"), (None, "same"), (None, None), (-big, "alone")]
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id bigint, url string, html string")).collect()}
    assert got == {(big + 1, "revisit", big + 2), (big + 2, "response", None), (None, "revisit", big + 2), (big + 3, "response", None), (None, "response", None), (-big, "response", None)}
    named = spark.createDataFrame([("a b\r\nö%", "x", "t"), ("z", "x", "t")], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.round_trip(named).collect()} == {("a b\r\nö%", "z"), ("z", None)}


def test_warc_reader_rejects_damage():
    def packed(raw):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(raw) + z.flush()

    good = warc.record(1, "u", b"payload")
    assert [r["payload"] for r in warc.read_records(io.BytesIO(packed(good) + packed(good)), True)] == [b"payload"] * 2
    for bad in (good.replace(b"payload", b"paYload"), good + b"x"):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(io.BytesIO(packed(bad))))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_records(io.BytesIO(packed(good)[:-12])))


def test_pieces_equal_the_library(spark, docs, empty):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = piece_bpe.pieces("piece_bpe_32k.model")
    rng = random.Random(3)
    normal = [p.replace("▁", " ") for p in model.normal]
    texts = ["", " ", "a\nb", "x\0y", "▁a", "a▁▁b", "日本🙂", "</s> <unk> <0x41>", "\ufeffhi", "\U0010ffff x", "the" * 3000, "x" * 5000, "-" * 999]
    texts += [end + " " * k + start for k in range(70) for end in ("", "b") for start in ("", "a", "日\n  ")]  # long rows of blanks
    texts += ["".join(rng.choices(normal, k=rng.randint(1, 60))) for _ in range(500)]
    texts += ["".join(rng.choices("ab aeinst\n.,1🙂é日=-", k=rng.randint(1, 200))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {r._id: r for r in piece_bpe.round_trip(rows).collect()}
    for k, text in enumerate(texts):
        want = library.encode(text, add_eos=True)
        assert got[k]._ids == want and got[k]._decoded == library.decode(want)
    listed = [rng.choices(range(300 if k % 3 else 32_000), k=rng.randint(0, 12)) for k in range(600)]  # bytes in any order
    said = piece_bpe.decoded(spark.createDataFrame(list(enumerate(listed)), "doc_id int, ids array<int>")).collect()
    assert all(r._decoded == library.decode(listed[r._id]) for r in said) and len(said) == 600
    assert [(r._ids, r._decoded) for r in piece_bpe.round_trip(docs).where("_id in (1, 2)").collect()] == [([2], "")] * 2
    assert piece_bpe.round_trip(docs).count() == docs.count() and piece_bpe.round_trip(empty).count() == 0
    assert piece_bpe.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")).collect()[0]._decoded == ""


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_spelling_links_and_roots(spark, docs, empty):
    rng = random.Random(2)
    made = {"".join(rng.choices("abcé", k=rng.randint(1, 8))) for _ in range(900)} | {"".join(rng.choices(["th", "er", "in"], k=rng.randint(3, 9))) for _ in range(900)}
    made |= {"x" * k for k in range(1, 40)} | {"long" * 500, "long" * 499 + "lon"}
    many = {w: rng.choice([5, 6, 30, 200, 1100]) for w in made}
    near = {w: set() for w in made}
    for a, b in itertools.combinations(sorted(made, key=len), 2):
        if len(b) - len(a) <= 1 and _near(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in made:
        best = min(near[w], key=lambda v: (-many[v], v), default=None)
        form[w] = best if best is not None and many[best] >= 5 * many[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    vocab = spark.createDataFrame(list(many.items()), "_word string, _n bigint")
    want = {w: (many[w], len(near[w]), form[w], form[w] and many[form[w]], root(w)) for w in made}
    for most in (1000, 3):  # lists as they are, and split down to one open letter
        got = spelling.variants(vocab, most=most).collect()
        assert {r._word: (r._n, r._near, r._form, r._form_n, r._root) for r in got} == want and len(got) == len(made)
    assert any(form[f] for f in form.values() if f) and max(map(len, near.values())) > 5
    assert spelling.variants(spelling.vocabulary(spelling.words(empty))).count() == 0


def test_spelling_words(spark, docs):
    rows = spark.createDataFrame([(7, "ÄPFELBÄUME äpfelbäume Ab abcdefgh-ABCDEFGH"), (None, "without"), (3, None), (3, "")], "doc_id bigint, text string")
    assert sorted(r._word for r in spelling.words(rows).collect()) == ["abcdefgh", "abcdefgh", "without", "ÄpfelbÄume", "äpfelbäume"]
    words = [(k, "".join(random.Random(k).choices("abcdefgß", k=9))) for k in range(2000)] + [(None, "nothings")] * 3
    want = []
    for k, w in words:
        h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
        want.append(w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :])
    slipped = spelling.slips(spark.createDataFrame(words, "_id bigint, _word string"))
    assert Counter(r._word for r in slipped.collect()) == Counter(want) and 0 < sum(len(w) == 8 for w in want) < 50
    assert spelling.vocabulary(spelling.words(docs), least=40).count() == 0 and spelling.words(docs).columns == ["_id", "_word"]


def _runs(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_periodic_runs(spark, docs, empty):
    rng = random.Random(4)
    texts = [[], ["one"], ["a"] * 500, ["a", "b"] * 6, ["a", "b"] * 5 + ["a"], [f"w{k}" for k in range(300)] * 2]
    for _ in range(400):
        said = [rng.choice("ab cd efghij".split() if rng.random() < 0.1 else "abc") for _ in range(rng.randint(0, 90))]
        if len(said) > 3 and rng.random() < 0.6:
            a = rng.randrange(len(said))
            p = rng.randint(1, max(1, (len(said) - a) // 2))
            said = [said[i if i < a else a + (i - a) % p] for i in range(len(said))]
        texts.append(said)
    rows = spark.createDataFrame([(k, " \t\n"[k % 3].join(t) + "\r\x0b "[: k % 3]) for k, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    got = {r._id: r for r in periodic_runs.periodic_runs(rows).collect()}
    for k, t in enumerate(texts):
        want = _runs(t)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert [tuple(r) for r in got[k]._runs] == want
        assert got[k]._collapsed == " ".join(w for i, w in enumerate(t) if i not in gone)
    odd = periodic_runs.periodic_runs(docs).collect()
    assert len(odd) == docs.count() and next(r for r in odd if r._id == 8)._runs[0].period == 4
    assert all(r._runs == [] and r._collapsed == "" for r in odd if r._id in (1, 2))
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_periodic_repeats(spark, docs):
    rows = [(k, " \n".join(f"w{i}" for i in range(k % 37))) for k in range(300)] + [(None, "a  b"), (5, None)]
    got = Counter((r._id, r._text) for r in periodic_runs.with_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    want = Counter()
    for k, text in rows:
        h, said = zlib.crc32(str(k).encode()), (text or "").split()
        if k is not None and h % 10 == 0 and said:
            n, g = len(said), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(said[i if i < a else a + (i - a) % p] for i in range(n))
        want[k, text] += 1
    assert got == want
