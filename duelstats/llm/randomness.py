"""Secret scan: known patterns, and a battery of randomness tests over all other long runs of encoded characters.

Every run of 20 and more characters of an encoding gets three tests under the encoding's alphabet, the smallest that holds it: chi-squared
uniformity, runs above and below the middle of the alphabet, and serial correlation of neighbours. A run that the battery finds
unlike random characters is dropped. For the others the chi-squared statistic is also held against written language, which repeats
letters: how often would a run of this length from language look so even? These p-values go through the Benjamini-Hochberg rule
within each class of length and alphabet, over the whole corpus; histograms of bounded size stand for the sorted list, rounded to the
safe side. Short runs, which say little, thus need more evidence. Everything is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelstats.session import cut

# fixed values: the known patterns, and the least lengths of what they find
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# name, what it looks like, its letters, how often two letters of language agree in it
ALPHABETS = (
    ("decimal", r"^[0-9]+$", DIGITS, 0.12),
    ("lower_hex", r"^[0-9a-f]+$", DIGITS + LOWER[:6], 0.11),
    ("upper_hex", r"^[0-9A-F]+$", DIGITS + UPPER[:6], 0.11),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567", 0.065),
    ("lower", r"^[0-9a-z]+$", DIGITS + LOWER, 0.065),
    ("upper", r"^[0-9A-Z]+$", DIGITS + UPPER, 0.065),
    ("base64", r"", UPPER + LOWER + DIGITS + "+/", 0.065),
)
RANDOM_ALPHA = 0.001
FALSE_SHARE = 0.01
BINS_A_DECADE, MOST_DECADES = 20, 300


def below(z: Column) -> Column:
    """Probability of a standard normal value below ``z``, also far out (series of the tail beyond -3)."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + 0.2316419 * x)
    # fixed values: the polynomial of Abramowitz and Stegun, 26.2.17
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = density / x * (1 - 1 / (x * x) + 3 / (x * x * x * x))
    upper = F.when(x > 3, far).otherwise(near)
    return F.when(z > 0, 1 - upper).otherwise(upper)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Array of (kind, number, length of the text before it since the last match, match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    each = F.transform(F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), F.length(x["b"]).alias("before"), x["m"].alias("match")))
    return F.when(F.size(found) > 0, each).otherwise(F.array().cast("array<struct<kind:int,number:int,before:int,match:string>>"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (``_doc``, ``_id``) and all matches of the known patterns and of ``RUN``: ``_doc``, ``kind`` (place in KINDS),
    ``start``, ``end`` (code points, end outside), ``match``. Leftmost and without overlaps within a kind."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    every = F.concat(*[_matches(text, p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX, RUN))])
    landed = cut(docs.select(F.col(f"`{id_col}`").alias("_id"), every.alias("_found"), F.monotonically_increasing_id().alias("_doc")))
    rows = landed.select("_doc", F.explode("_found").alias("f")).select("_doc", "f.*").withColumn("_len", F.length("match"))
    in_order = Window.partitionBy("_doc", "kind").orderBy("number")  # the matches of one document
    placed = rows.withColumn("end", F.sum(F.col("before") + F.col("_len")).over(in_order))
    placed = placed.withColumn("start", F.col("end") - F.col("_len"))
    value = F.regexp_extract("match", ASSIGN, 1)
    kept = placed.where((F.col("kind") != 0) | (F.length(value) >= ASSIGN_LEAST))
    return landed.select("_doc", "_id"), kept.select("_doc", "kind", "start", "end", "match")


def battery(runs: DataFrame) -> DataFrame:
    """Add to rows with ``match``: ``alphabet``, ``n``, ``p_random`` (battery, two-sided, Bonferroni) and ``p_language``."""
    body = F.regexp_replace(F.translate("match", "-_", "+/"), "=+$", "")
    looks = F.lit(ALPHABETS[-1][0])
    for name, pattern, _, _ in reversed(ALPHABETS[:-1]):
        looks = F.when(F.col("body").rlike(pattern), F.lit(name)).otherwise(looks)

    def choose(value) -> Column:
        got = F.lit(value(ALPHABETS[-1]))
        for a in ALPHABETS[:-1]:
            got = F.when(F.col("alphabet") == a[0], F.lit(value(a))).otherwise(got)
        return got

    df = runs.withColumn("body", body).withColumn("alphabet", looks).withColumn("letters", choose(lambda a: a[2]))
    df = df.withColumn("n", F.length("body").cast("double")).withColumn("k", F.length("letters").cast("double")).withColumn("same", choose(lambda a: a[3]))
    counts = F.transform(F.split("letters", ""), lambda c: F.when(F.length(c) > 0, F.length("body") - F.length(F.replace(F.col("body"), c, F.lit("")))).otherwise(0))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    free = F.col("k") - 1
    df = df.withColumn("chi", squares * F.col("k") / F.col("n") - F.col("n"))
    cube = 2 / (9 * free)
    z_even = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - cube)) / F.sqrt(cube)

    df = df.withColumn("bits", _halves())
    ones = F.length(F.replace(F.col("bits"), F.lit("0"), F.lit(""))).cast("double")
    zeros = F.col("n") - ones
    changes = (2 * F.length("bits") - F.length(F.replace(F.col("bits"), F.lit("01"), F.lit(""))) - F.length(F.replace(F.col("bits"), F.lit("10"), F.lit("")))) / 2
    mean = 2 * ones * zeros / F.col("n") + 1
    spread = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    z_runs = F.when(spread > 0, (changes + 1 - mean) / F.sqrt(spread)).otherwise(F.sqrt("n"))

    each = F.filter(F.split("body", ""), lambda c: F.length(c) > 0)
    df = df.withColumn("places", F.transform(each, lambda c: F.instr(F.col("letters"), c).cast("double")))
    total = F.aggregate("places", F.lit(0.0), lambda s, v: s + v)
    square = F.aggregate("places", F.lit(0.0), lambda s, v: s + v * v)
    start = F.struct(F.lit(0.0).alias("s"), F.element_at("places", -1).alias("p"))
    product = F.aggregate("places", start, lambda a, v: F.struct((a["s"] + a["p"] * v).alias("s"), v.alias("p")))["s"]  # the last meets the first
    scatter = F.col("n") * square - total * total
    z_serial = F.when(scatter > 0, (F.col("n") * product - total * total) / scatter * F.sqrt("n")).otherwise(F.sqrt("n"))

    two_sided = lambda z: 2 * below(-F.abs(z))
    # too even is as little random as too uneven
    p_random = F.least(F.lit(1.0), 3 * F.least(two_sided(z_even), two_sided(z_runs), two_sided(z_serial)))
    excess = F.col("n") * F.greatest(F.col("k") * F.col("same") - 1, F.lit(0.0))
    p_language = below((F.col("chi") - free - excess) / F.sqrt(2 * (free + 2 * excess)))
    return df.withColumn("p_random", p_random).withColumn("p_language", p_language).drop("body", "letters", "k", "same", "chi", "bits", "places")


def _halves() -> Column:
    """Characters of the lower and the upper half of the run's alphabet as 0 and 1."""
    got = F.lit("")
    for name, _, letters, _ in ALPHABETS:
        half = len(letters) // 2
        got = F.when(F.col("alphabet") == name, F.translate("body", letters, "0" * half + "1" * (len(letters) - half))).otherwise(got)
    return got


def discoveries(tested: DataFrame, false_share: float = FALSE_SHARE, alpha: float = RANDOM_ALPHA) -> DataFrame:
    """The rows that pass as random and are no more than ``false_share`` false within their class of length and alphabet."""
    bin_of = F.least(F.floor(-F.log10(F.greatest("p_language", F.lit(10.0**-MOST_DECADES))) * BINS_A_DECADE), F.lit(MOST_DECADES * BINS_A_DECADE - 1)).cast("int")
    classed = tested.withColumn("_class", F.floor(F.log2("n") * 2)).withColumn("_bin", bin_of)
    sums = classed.groupBy("alphabet", "_class", "_bin").agg(F.count(F.lit(1)).alias("_rows"))
    per_class = Window.partitionBy("alphabet", "_class")  # at most MOST_DECADES * BINS_A_DECADE rows
    smaller = F.sum("_rows").over(per_class.orderBy(F.col("_bin").desc()))
    largest_p = F.pow(F.lit(10.0), -F.col("_bin") / BINS_A_DECADE)  # of the bin
    passing = sums.withColumn("_upto", smaller).withColumn("_all", F.sum("_rows").over(per_class)).where(largest_p <= F.col("_upto") * false_share / F.col("_all"))
    lines = passing.groupBy("alphabet", "_class").agg(F.min("_bin").alias("_line"))
    found = classed.join(lines, ["alphabet", "_class"]).where((F.col("_bin") >= F.col("_line")) & (F.col("p_random") >= alpha))
    return found.drop("_class", "_bin", "_line")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id`` and ``_spans``, an array of (start, kind number, end) in order; ``kind`` counts as in KINDS.

    Null and empty texts have no spans. Rows stay apart even where they share an identifier. A random run inside a span of a known
    pattern is not told twice. An empty table gives an empty result; further columns aren't read.
    """
    documents, found = spans(docs, id_col, text_col)
    known = found.where("kind < 3").select("_doc", "start", "kind", "end")
    runs = cut(battery(found.where("kind = 3")))
    added = discoveries(runs).select("_doc", "start", "kind", "end")
    each = known.unionByName(added).groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("_spans"))
    inside = lambda s: F.exists("_spans", lambda b: (b["kind"] < 3) & (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    each = each.withColumn("_spans", F.filter("_spans", lambda s: (s["kind"] < 3) | ~inside(s)))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return documents.join(each, "_doc", "left").select("_id", F.coalesce("_spans", none).alias("_spans"))


def told(spans_col: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
