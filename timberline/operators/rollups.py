"""Counts, rollups and lists of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import WOOD_TIER, is_option, is_wood
from ..functions.money import exact_mean, retail
from ..functions.text import stripped
from ..plans.catalog import dealt

THIN_ROWS = 150


def filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def is_item() -> Column:
    return F.lower(F.coalesce("line_kind", F.lit("item"))) != "addon"


def stats(rows: DataFrame) -> DataFrame:
    """Rows, and distinct vendors, collections and files, blanks left out."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_distinct(filled(c)).alias(n) for c, n in (("vendor", "vendors"), ("collection", "collections"), ("source_file", "sources"))])


def vendor_summary(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """One row per vendor with its counts, price range, mean multiplier and saved settings (name, multiplier, phone, updated_at)."""
    by = rows.filter(is_item() & filled("vendor").isNotNull()).groupBy("vendor")
    out = by.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("collection").alias("n_collections"), F.count_distinct("source_file").alias("n_sources"), F.min("base_price").alias("min_base"), F.max("base_price").alias("max_base"), exact_mean(F.col("multiplier")).alias("avg_multiplier"))
    saved = settings.select(F.col("name").alias("vendor"), F.col("multiplier").alias("saved_multiplier"), "phone")
    return out.join(saved, "vendor", "left")


def thin_catalogs(rows: DataFrame, below: int = THIN_ROWS) -> DataFrame:
    by = rows.filter(is_item() & filled("vendor").isNotNull()).groupBy("vendor").agg(F.count(F.lit(1)).alias("n_rows"))
    return by.filter(F.col("n_rows") < below).orderBy("n_rows", "vendor")


def distinct_values(rows: DataFrame, column: str, vendor: str | None = None) -> DataFrame:
    rows = rows.filter(F.col("vendor") == vendor) if vendor and vendor != "All" else rows
    return rows.filter(filled(column).isNotNull()).select(column).distinct().orderBy(column)


def rows_per(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), column)


def mismatches(rows: DataFrame) -> DataFrame:
    """How many items have a retail price other than their wholesale price and multiplier give."""
    off = F.abs(F.col("adjusted_price") - retail(F.col("base_price"), F.col("multiplier"))) > 0.02
    return rows.filter(off).agg(F.count(F.lit(1)).alias("n_mismatched"))


def rollup(rows: DataFrame) -> DataFrame:
    """Extension: counts and price range by vendor and collection, with subtotals (level 0: both, 1: vendor, 3: all)."""
    return rows.filter(is_item()).rollup("vendor", "collection").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_rows"), F.min("base_price").alias("min_base"), F.max("base_price").alias("max_base"))


def species_pivot(rows: DataFrame, woods: list[str], parts: int | None = None) -> DataFrame:
    """Extension: a row per product, a column of prices per wood."""
    return dealt(rows.select("vendor", "part_number", "species", "base_price"), parts, "vendor", "part_number").groupBy("vendor", "part_number").pivot("species", woods).agg(F.min("base_price"))


def one_case(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Of labels that differ only in case the one that begins with a capital, then the least."""
    first = F.substring("label", 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    order = F.struct((~capital).cast("int"), F.col("label"))
    return labels.groupBy(*keys, F.lower("label").alias("_low")).agg(F.min(order).alias("_best")).select(*keys, F.col("_best.label").alias("label"))


def option_facet(rows: DataFrame) -> DataFrame:
    """(vendor, label): labels of charges, stored options, and species that are options."""
    item = is_item()
    charge = F.when(~item, F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("option_key", "description", "part_number")]))
    # patterns meet distinct values only: Spark would move a filter on these to before distinct(), but not past an array's rows
    distinct = rows.select("vendor", charge.alias("_charge"), F.when(item, F.col("option_key")).alias("_key"), F.when(item, F.col("species")).alias("_kind")).distinct()
    key, kind = stripped(F.col("_key")), stripped(F.col("_kind"))
    label = F.explode(F.array("_charge", F.when(is_option(key, True), key), F.when(is_option(kind), kind)))
    return one_case(distinct.select("vendor", label.alias("label")).filter("label is not null").distinct(), ["vendor"])


def species_facet(rows: DataFrame) -> DataFrame:
    """(vendor, label): single woods of all labels that are no options; wood tiers stay whole."""
    s = stripped(F.col("species"))
    whole = s.rlike(WOOD_TIER) | (s.rlike(r"\d/\d") & ~s.contains(" / "))
    # conditions stand in the array and rows without labels go later, so that patterns meet distinct values only
    atoms = F.when((s != "") & ~is_option(s), F.when(whole, F.array(s)).otherwise(F.split(s, r"\s*/\s*")))
    labels = rows.select("vendor", "species").distinct().select("vendor", F.explode_outer(atoms).alias("label"))
    return one_case(labels.filter(is_wood(F.col("label"))).distinct(), ["vendor"])


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, fingerprint): a sum of digests of ids and parts, so that rows need no order and add up before the shuffle."""
    digest = F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(":"), "part_number"), 256), 1, 14)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.conv(digest, 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def stats_with_quotes(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """stats() and the number of quotes."""
    return stats(rows).crossJoin(quotes.agg(F.count(F.lit(1)).alias("quotes")))  # one row each


def active(users: DataFrame) -> DataFrame:
    """(n_users, n_active) of users (active)."""
    return users.agg(F.count(F.lit(1)).alias("n_users"), F.count_if(F.coalesce("active", F.lit(False))).alias("n_active"))
