"""Card catalogs: JSON lists, official base snapshots, database tables; one row per hash in the end."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelstats.functions import decks
from duelstats.functions.ranks import first_text
from duelstats.functions.text import strip

# Names under which catalogs keep a card's hashes, pictures and facts.
HASH_KEYS = ("hash_id", "hashId", "card_hash", "cardHash", "code", "card_small_code", "cardSmallCode")
KEY_POCKETS = ("image_keys", "imageKeys", "image_keys_json")
URL_POCKETS = ("image_urls", "imageUrls", "images", "image_urls_json")
SMALL_KEYS = ("card_small_code", "cardSmallCode", "card_small", "cardSmall")
PICTURE_KEYS = (
    "card_small", "cardSmall", "card_small_url", "cardSmallUrl", "small", "card_ds", "cardDs", "card_ds_url", "cardDsUrl", "card_face", "cardFace",
    "card_face_url", "cardFaceUrl", "face",
)
PICTURE_FIELDS = ("image_url", "imageUrl", "card_small_url", "cardSmallUrl", "card_ds_url", "cardDsUrl", "card_face_url", "cardFaceUrl")
TABLE_COLUMNS = (
    "card_code", "name", "cost_label", "cost_value", "unit_type", "faction", "rarity", "card_type", "image_keys_json", "image_urls_json",
)
CARD_COLUMNS = ["seq", "hashes", "card_code", "name", "cost_label", "cost", "unit_type", "faction", "rarity", "card_type", "image_key", "image_url"]
EMPTY_MAP = "map<string,string>"


def _variant_text(v: Column, *keys: str) -> Column:
    return first_text(*[strip(F.try_variant_get(v, f"$.{k}", "string")) for k in keys])


def _variant_map(v: Column, *keys: str) -> Column:
    """First pocket that holds an object, directly or as JSON text."""
    held = [F.try_variant_get(v, f"$.{k}", EMPTY_MAP) for k in keys]
    quoted = [F.from_json(F.try_variant_get(v, f"$.{k}", "string"), EMPTY_MAP) for k in keys]
    return F.coalesce(*held, *quoted, F.create_map().cast(EMPTY_MAP))


def _shaped(rows: DataFrame, hashes: Column, code: Column, name: Column, costs: list[Column], facts: dict[str, Column], keys: Column, urls: Column, own_url: Column) -> DataFrame:
    texts = F.array_distinct(F.filter(F.transform(hashes, strip), lambda h: h.isNotNull() & (h != "")))
    pick = lambda m, names: first_text(*[m[n] for n in names])
    url = first_text(pick(urls, PICTURE_KEYS), F.get(F.map_values(urls), F.lit(0)), own_url)
    return rows.select(
        "seq", texts.alias("hashes"), code.alias("card_code"), name.alias("name"), first_text(*costs).alias("cost_label"), decks.card_cost(*costs).alias("cost"),
        *[c.alias(n) for n, c in facts.items()], pick(keys, SMALL_KEYS).alias("image_key"), url.alias("image_url"),
    ).where(F.size("hashes") > 0).select(*CARD_COLUMNS)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Catalog file: ``{"cards": [...]}`` or a bare list. A catalog is one document of a few thousand cards."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.cards", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    rows = whole.select(F.posexplode(listed).alias("seq", "c"))
    c = F.col("c")
    keys, urls = _variant_map(c, *KEY_POCKETS), _variant_map(c, *URL_POCKETS)
    hashes = F.concat(F.array(*[F.try_variant_get(c, f"$.{k}", "string") for k in HASH_KEYS]), F.map_values(keys))
    costs = [F.try_variant_get(c, f"$.{k}", "string") for k in ("cost", "cost_label", "cost_value", "costValue")]
    facts = {
        "unit_type": _variant_text(c, "unitType", "unit_type"),
        "faction": _variant_text(c, "faction"),
        "rarity": _variant_text(c, "rarity"),
        "card_type": _variant_text(c, "card_type", "cardType"),
    }
    return _shaped(
        rows, hashes, _variant_text(c, "card_code", "cardCode", "code"), _variant_text(c, "name", "rawName"), costs, facts, keys, urls, _variant_text(c, *PICTURE_FIELDS)
    )


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """Official base snapshot: CSV rows whose codes point into sibling arrays of the same document."""
    tables = ("color", "cardType", "cost", "unitType", "indexInitial")
    schema = ", ".join(f"{t} array<string>" for t in ("general", *tables))
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    rows = doc.select("d", F.posexplode("d.general").alias("seq", "text")).withColumn("r", F.split("text", ",")).where(F.size("r") >= 16)
    field = lambda i: F.get("r", F.lit(i))
    number = lambda i: strip(field(i)).try_cast("int")

    def told(table: str, i: int) -> Column:
        parts = F.split(F.get(F.col(f"d.{table}"), F.when(number(i) >= 0, number(i))), ",")
        return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), F.lit(""))

    prefix = F.get(F.col("d.indexInitial"), F.when(number(10) >= 0, number(10)))
    digits = F.when(F.length(field(12)) < 3, F.lpad(number(12).cast("string"), 3, "0")).otherwise(number(12).cast("string"))
    code = F.coalesce(F.concat(prefix, digits), F.lit(""))
    empty = F.create_map().cast(EMPTY_MAP)
    facts = {"unit_type": told("unitType", 15), "faction": told("color", 5), "rarity": F.lit(""), "card_type": told("cardType", 11)}
    keys = F.create_map(F.lit("card_small"), field(0), F.lit("card_ds"), field(1), F.lit("card_face"), field(2))
    return _shaped(rows, F.array(field(0), field(1), field(2)), code, field(3), [told("cost", 13)], facts, keys, empty, F.lit(""))


def _in_load_order(table: DataFrame) -> DataFrame:
    """``table`` with the place it was loaded from as ``seq``: file and row where files tell them, else the order of reading."""
    try:
        return table.withColumn("seq", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    except AnalysisException as e:
        if not e.getCondition().startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND")):
            raise
    return table.withColumn("seq", F.struct(F.lit("").alias("file_path"), F.monotonically_increasing_id().alias("row_index")))


def from_table(table: DataFrame) -> DataFrame:
    """Card table of a database (any DataFrame, for instance a JDBC read); absent columns count as empty. Of rows that share a
    hash the one loaded last counts."""
    have = {c: strip(F.col(c).cast("string")) if c in table.columns else F.lit("") for c in TABLE_COLUMNS}
    rows = _in_load_order(table)
    keys = F.coalesce(F.from_json(have["image_keys_json"], EMPTY_MAP), F.create_map().cast(EMPTY_MAP))
    urls = F.coalesce(F.from_json(have["image_urls_json"], EMPTY_MAP), F.create_map().cast(EMPTY_MAP))
    facts = {c: F.coalesce(have[c], F.lit("")) for c in ("unit_type", "faction", "rarity", "card_type")}
    hashes = F.concat(F.map_values(keys), F.array(have["card_code"]))
    return _shaped(rows, hashes, first_text(have["card_code"]), first_text(have["name"]), [have["cost_label"], have["cost_value"]], facts, keys, urls, F.lit(""))


def by_hash(cards: DataFrame) -> DataFrame:
    """One row per hash; of cards that share a hash the last one counts."""
    rows = cards.select(F.explode("hashes").alias("card_hash"), *[c for c in CARD_COLUMNS if c != "hashes"])
    rest = [c for c in CARD_COLUMNS if c not in ("hashes", "seq")]
    return rows.groupBy("card_hash").agg(F.max_by(F.struct(*rest), F.struct("seq", "card_code", "name")).alias("c")).select("card_hash", "c.*")


def overlaid(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Union of two dimensions where the overlay wins per hash."""
    return overlay.unionByName(base.join(overlay.select("card_hash"), "card_hash", "left_anti"))


def overlay_cards(snapshot: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cards of a base snapshot whose primary hash the catalog lacks."""
    primary = snapshot.withColumn("primary", F.get("hashes", F.lit(0)))
    return primary.join(catalog.select(F.col("card_hash").alias("primary")), "primary", "left_anti").drop("primary")


def load(spark: SparkSession, table: DataFrame | None = None, base_dir: str = "", legacy: str = "", overlay: str = "") -> DataFrame | None:
    """First catalog that has cards: the database table, else the newest base snapshot, else the legacy file."""
    ways = []
    if table is not None:
        ways.append(lambda: from_table(table))
    if base_dir:
        ways.append(lambda: read_base(spark, newest(spark, base_dir)))
    if legacy:
        ways.append(lambda: read_json(spark, legacy))
    for way in ways:
        dim = by_hash(way())
        if not dim.isEmpty():
            return overlaid(dim, by_hash(read_json(spark, overlay))) if overlay else dim
    return None


def newest(spark: SparkSession, folder: str) -> str:
    """Most recently written JSON file of a folder."""
    files = spark.read.option("pathGlobFilter", "*.json").format("binaryFile").load(folder).select("path", "modificationTime")
    return files.agg(F.max_by("path", "modificationTime").alias("p")).first()["p"]


def small_picture(dim: DataFrame, template: str) -> Column:
    """Address of the small picture; ``template`` holds ``{key}``."""
    head, tail = template.split("{key}")
    return F.concat(F.lit(head), F.url_encode(first_text(F.col("image_key"), F.col("card_hash"))), F.lit(tail))


def shown_code(card: Column, code: Column) -> Column:
    """Code of a card; an unknown hash that looks like a code stands for itself."""
    return F.when(F.coalesce(code, F.lit("")) != "", code).when(decks.looks_like_code(card), card).otherwise("")
