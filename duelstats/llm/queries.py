"""The operators over the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelstats.llm import content_sort, importance, mixing, near_dedup, periodic_runs, phrase_index, piece_bpe, randomness, spelling, suffix_buckets, token_counts, toxicity, warc
from duelstats.llm.base import ORACLES, QUERIES, query, table
from duelstats.session import cut

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win))),
m AS (SELECT rid, p, n, item_id FROM dw JOIN win USING (n, g)),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM m)) GROUP BY 1),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)"""


@query("op1_decontamination", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"),
        F.col("_n").alias("n_words"),
        F.col("_hit").alias("n_hit"),
        F.col("_items").alias("n_items"),
        F.sha2(F.encode(F.array_join("_item_list", ","), "UTF-8"), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


@query("op2_repeated_strings")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_buckets.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select(F.col("_id").alias("doc_id"), F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.col("_sha").alias("kept_sha256"))


@query("op3_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("_id").alias("doc_id"), F.col("_class").alias("class_id"), F.col("_size").alias("class_size"), F.col("_stays").alias("kept"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = randomness.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("_spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        F.col("_id").alias("doc_id"),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(randomness.KINDS)],
        F.sha2(F.encode(randomness.told(base), "UTF-8"), 256).alias("base_sha256"),
        randomness.told(F.col("_spans")).alias("spans"),
    )


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("_id").alias("doc_id"), toxicity.held_out("_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted")
    )


@query("op8_importance_resampling")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select(F.col("_id").alias("doc_id"), F.col("_weight").alias("log_weight"), F.col("_draw").alias("draw"), F.col("_selected").alias("selected"))


OP6 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""


@query("op6_exact_dedup", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = content_sort.exact_groups(table(spark, sf_dir, "documents"), keep="largest")
    return groups.select(F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return counts.select(F.col("_id").alias("doc_id"), F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > 1024).alias("over_limit"))


OP9 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, (SELECT sum(source_size) FROM s)::DOUBLE AS total, (SELECT sum(weight) FROM w) AS weights,
         coalesce(sum(3.0::DOUBLE * source_size) OVER f, 0) AS most_before, coalesce(sum(weight) OVER f, 0) AS weight_before
  FROM w WINDOW f AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - most_before) / (weights - weight_before) AS lev FROM l),
t AS (
  SELECT source, source_size, CASE WHEN most <= weight * lev THEN most
         ELSE weight * (SELECT arg_min(lev, most / weight) FROM v WHERE most > weight * lev) END AS target FROM v),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
a AS (SELECT source, h, sum(size) AS atom FROM d GROUP BY 1, 2),
c AS (SELECT *, sum(atom) OVER (PARTITION BY source ORDER BY h) - atom AS before FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS nth FROM d)
SELECT d.doc_id, d.size, g.source_size, g.target,
       CAST(d.size * (g.whole + CASE WHEN c.before + (nth - 1) * d.size + d.size / 2.0 < g.target - g.whole * g.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h"""


@query("op9_mix_sources", OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS best FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM d"""


@query("op10_warc_round_trip", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


@query("op11_sentencepiece")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_bpe.round_trip(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    told = F.array_join(F.col("_ids").cast("array<string>"), " ")
    return coded.select(
        F.col("_id").alias("doc_id"),
        F.size("_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("_decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


# the checksum of gzip and zlib (its polynomial is a fixed value) over a list of bytes, bit by bit
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode({0}))) // 2),
  lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP12 = rf"""
WITH RECURSIVE r AS (
  SELECT translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, coalesce(CAST(doc_id AS VARCHAR), '') AS id
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 6),
k AS (SELECT id, w, count(*) AS c FROM r GROUP BY 1, 2),
h AS (SELECT *, {CRC32.format("id || ':' || w")} AS h FROM k),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
d AS (SELECT word, n, length(word) AS l, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN d b ON a.word = b.cut
  UNION SELECT b.word, a.word, a.n FROM v a JOIN d b ON a.word = b.cut),
g AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM e GROUP BY 1),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN g USING (word)),
way AS (SELECT word, word AS at FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN way USING (word) JOIN f z ON z.word = way.at WHERE z.form IS NULL"""


@query("op12_spelling_variants", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = spelling.vocabulary(spelling.slips(spelling.words(table(spark, sf_dir, "documents"))))
    found = spelling.variants(cut(vocab))
    return found.select(
        F.col("_word").alias("word"),
        F.col("_form").alias("form"),
        F.col("_root").alias("root"),
        F.col("_n").alias("n"),
        F.col("_near").alias("n_near"),
        F.col("_form_n").alias("form_n"),
    )


OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, CAST(doc_id AS VARCHAR) AS id FROM documents),
h AS (SELECT *, len(o) AS n, {CRC32.format("id")} AS h FROM d),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM h),
p AS (SELECT rid, doc_id, o, n, a, 1 + (n - a) // (3 + g % 8) AS p FROM g),
t AS (
  SELECT rid, i, CASE WHEN a IS NULL OR i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
six AS (SELECT rid, i, string_agg(w, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s FROM t),
like_ AS (SELECT a.rid, a.i, b.i - a.i AS q FROM six a JOIN six b ON a.rid = b.rid AND a.s = b.s AND a.i < b.i),
island AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM like_),
pair AS (SELECT rid, q, min(i) AS start, count(*) + 5 + q AS length FROM island GROUP BY rid, q, k),
run AS (SELECT rid, start, length, min(q) AS period FROM pair WHERE length >= greatest(12, 2 * q) GROUP BY 1, 2, 3),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS s FROM t ANTI JOIN gone USING (rid, i) GROUP BY 1),
r AS (
  SELECT rid, count(*) AS n_runs, first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told
  FROM run GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(s, '')) AS collapsed_sha256
FROM p LEFT JOIN r USING (rid) LEFT JOIN kept USING (rid)"""


@query("op13_periodic_runs", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeated = periodic_runs.with_repeats(table(spark, sf_dir, "documents"))
    found = periodic_runs.periodic_runs(repeated, id_col="_id", text_col="_text")
    ranked = F.transform("_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter")))
    best = F.array_max(ranked)
    told = F.array_join(F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("*", best.alias("_best")).select(
        F.col("_id").alias("doc_id"),
        F.size("_runs").cast("bigint").alias("n_runs"),
        (-F.col("_best.before")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.shorter")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.shorter")).alias("exponent_milli"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("_collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict:
    return dict(ORACLES)
