"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of postings (term, document, position) of all corpus words that occur in a test. A phrase is looked up from its
rarest terms: their postings, each moved back by the term's place in the phrase, are intersected list by list, and only what is left
meets the postings of the phrase's other terms. Rarity is counted in the index. Everything is DataFrame code; no group is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelstats.llm.base import land, small
from duelstats.session import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
PROBES = 3
SMALL = 200_000  # rows of test terms or probes that may be broadcast; beyond, they are joined by a shuffle


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _hint(df: DataFrame, most: int = SMALL) -> DataFrame:
    kept, fits = small(df, most)
    return F.broadcast(kept) if fits else kept


class PhraseIndex:
    """Postings of the terms that the phrases of ``items`` use, over all ``docs``.

    ``documents``: ``_doc`` (row number), ``_id``, ``_n`` (words); ``postings``: ``_term``, ``_doc``, ``_at``; ``items``: ``_item``,
    ``_item_id``, ``_len``; ``terms``: ``_item``, ``_place``, ``_term``, ``_len``. Null and empty texts have no postings, items without words no
    phrases; rows with one identifier stay apart, as documents and as items. Further columns aren't read.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"):
        tests = cut(items.select(F.col(f"`{item_col}`").alias("_item_id"), words(F.col(f"`{item_text_col}`")).alias("_words"), F.monotonically_increasing_id().alias("_item")))
        self.items = tests.select("_item", "_item_id", F.size("_words").alias("_len"))
        places = tests.select("_item", F.size("_words").alias("_len"), F.posexplode("_words").alias("_place", "_word"))
        vocabulary = cut(places.select("_word").distinct().withColumn("_term", F.monotonically_increasing_id()))
        tokens = land(docs.select(F.col(f"`{id_col}`").alias("_id"), words(F.col(f"`{text_col}`")).alias("_words"), F.monotonically_increasing_id().alias("_doc")))
        self.documents = tokens.select("_doc", "_id", F.size("_words").cast("bigint").alias("_n"))
        known = _hint(vocabulary)
        self.postings = land(tokens.select("_doc", F.posexplode("_words").alias("_at", "_word")).join(known, "_word").select("_term", "_doc", "_at"))
        counts = self.postings.groupBy("_term").agg(F.count(F.lit(1)).alias("_freq"))
        self.vocabulary = cut(vocabulary.join(counts, "_term", "left").select("_term", "_word", F.coalesce("_freq", F.lit(0)).alias("_freq")))
        self.terms = cut(places.join(self.vocabulary, "_word").select("_item", "_place", "_term", "_len", "_freq"))

    def windows(self, length: int) -> DataFrame:
        """The phrases: ``length`` consecutive words of an item, or all of a shorter one: ``_item``, ``_start``, ``_size``."""
        starts = self.items.where(F.col("_len") > 0)
        last = F.greatest(F.col("_len") - length, F.lit(0))
        return starts.select("_item", F.explode(F.sequence(F.lit(0), last)).alias("_start"), F.least(F.col("_len"), F.lit(length)).alias("_size"))

    def probes(self, length: int, most: int) -> DataFrame:
        """The ``most`` rarest places of every phrase, the rarest first: ``_item``, ``_start``, ``_rank``, ``_place``, ``_term``, ``_used`` (probes of the phrase)."""
        inside = self.terms.join(self.windows(length), "_item").where(F.col("_place").between(F.col("_start"), F.col("_start") + F.col("_size") - 1))
        phrase = Window.partitionBy("_item", "_start")  # as long as a phrase
        ranked = inside.withColumn("_rank", F.row_number().over(phrase.orderBy("_freq", "_place"))).where(F.col("_rank") <= most)
        # a phrase with a term that the corpus lacks cannot occur
        return ranked.withColumn("_least", F.min("_freq").over(phrase)).where("_least > 0").select("_item", "_start", "_rank", "_place", "_term", F.least("_size", F.lit(most)).alias("_used"))

    def candidates(self, length: int = WINDOW, probes: int = PROBES) -> DataFrame:
        """Alignments on which some phrase's rarest terms all stand: ``_doc``, ``_item``, ``_shift`` (item place 0 is at this position)."""
        plan = cut(self.probes(length, probes))
        first = _hint(plan.where("_rank = 1").select("_item", "_start", "_place", "_term", "_used"))
        found = self.postings.join(first, "_term").select("_doc", "_item", "_start", "_used", (F.col("_at") - F.col("_place")).alias("_shift")).where("_shift + _start >= 0")
        for rank in range(2, probes + 1):
            more = plan.where(F.col("_rank") == rank)
            lists = self.postings.join(_hint(more.select("_term").distinct()), "_term", "left_semi")
            wanted = found.where(F.col("_used") >= rank).join(_hint(more.select("_item", "_start", "_place", "_term")), ["_item", "_start"]).withColumn("_at", F.col("_shift") + F.col("_place"))
            both = wanted.join(lists, ["_term", "_doc", "_at"]).select("_doc", "_item", "_start", "_used", "_shift")
            short = found.where(F.col("_used") < rank)
            found = cut(both.unionByName(short))
        return found.select("_doc", "_item", "_shift").distinct()

    def spans(self, length: int = WINDOW, probes: int = PROBES) -> DataFrame:
        """Every stretch of a document that equals ``length`` or more consecutive words of an item (all words of a shorter item):
        ``_doc``, ``_item``, ``_from``, ``_to`` (positions, both inside)."""
        aligned = cut(self.candidates(length, probes))
        wanted = aligned.join(_hint(self.terms.select("_item", "_place", "_term", "_len")), "_item").withColumn("_at", F.col("_shift") + F.col("_place"))
        lists = self.postings.join(aligned.select("_doc").distinct(), "_doc", "left_semi")
        equal = wanted.join(lists, ["_doc", "_at", "_term"]).select("_doc", "_item", "_shift", "_place", "_len")
        line = Window.partitionBy("_doc", "_item", "_shift").orderBy("_place")  # as long as an item
        runs = equal.withColumn("_run", F.col("_place") - F.row_number().over(line)).groupBy("_doc", "_item", "_shift", "_len", "_run")
        spans = runs.agg(F.min("_place").alias("_first"), F.max("_place").alias("_last")).where(F.col("_last") - F.col("_first") + 1 >= F.least(F.col("_len"), F.lit(length)))
        return spans.select("_doc", "_item", (F.col("_shift") + F.col("_first")).alias("_from"), (F.col("_shift") + F.col("_last")).alias("_to"))

    def near(self, length: int = WINDOW, probes: int = PROBES, reach: int = 2 * WINDOW) -> DataFrame:
        """Proximity matches: places where a phrase's rarest terms all stand within ``reach`` words of its rarest, in any order:
        ``_doc``, ``_item``, ``_start``, ``_at``."""
        plan = cut(self.probes(length, probes))
        first = _hint(plan.where("_rank = 1").select("_item", "_start", "_term", "_used"))
        anchors = self.postings.join(first, "_term").select("_doc", "_item", "_start", "_at", "_used")
        others = _hint(plan.where("_rank > 1").select("_item", "_start", "_term", "_rank"))
        block = F.floor(F.col("_at") / reach)
        asked = anchors.join(others, ["_item", "_start"]).select("*", F.explode(F.array(block - 1, block, block + 1)).alias("_block"))
        lists = self.postings.join(F.broadcast(plan.select("_term").distinct()) if plan.count() <= SMALL else plan.select("_term").distinct(), "_term", "left_semi")
        lists = lists.select("_term", "_doc", F.col("_at").alias("_there"), block.alias("_block"))
        met = asked.join(lists, ["_doc", "_term", "_block"]).where(F.abs(F.col("_there") - F.col("_at")) <= reach)
        full = met.groupBy("_doc", "_item", "_start", "_at", "_used").agg(F.countDistinct("_rank").alias("_met")).where("_met = _used - 1")
        return full.select("_doc", "_item", "_start", "_at").unionByName(anchors.where("_used = 1").select("_doc", "_item", "_start", "_at"))


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW, share: int = 20, **names) -> DataFrame:
    """One row per document: ``_id``, ``_n`` (words), ``_hit`` (words inside an occurrence of a window), ``_items`` (distinct item identifiers
    with an occurring window), ``_item_list`` (those, sorted as text), ``_contaminated`` (some hit, and at least 1 in ``share`` words).

    An empty table of documents gives an empty result; without items nothing is hit.
    """
    index = PhraseIndex(docs, items, **names)
    spans = cut(index.spans(length))
    hit = spans.select("_doc", F.explode(F.sequence("_from", "_to")).alias("_at")).distinct().groupBy("_doc").agg(F.count(F.lit(1)).alias("_hit"))
    named = spans.select("_doc", "_item").distinct().join(index.items, "_item").groupBy("_doc").agg(F.array_sort(F.collect_set(F.coalesce(F.col("_item_id").cast("string"), F.lit("null")))).alias("_item_list"))
    marked = cut(hit.join(named, "_doc"))
    whole = index.documents.join(marked, "_doc", "left")
    hits = F.coalesce("_hit", F.lit(0)).cast("bigint")
    items_of = F.coalesce("_item_list", F.array().cast("array<string>"))
    return whole.select("_doc", "_id", "_n", hits.alias("_hit"), F.size(items_of).cast("bigint").alias("_items"), items_of.alias("_item_list"), ((hits > 0) & (hits * share >= F.col("_n"))).alias("_contaminated"))
