"""Upkeep of catalog rows: what is kept, filled, matched and counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import builder_key, is_item_code, squeeze
from ..plans.catalog import dealt

# Builders whose lists are left alone, and marks of a bad reading.
IGNORED = ["green meadows", "simple living"]
SIZE_LIKE = r"(?i)^\d+(\.\d+)?(\s*[x×]\s*\d+(\.\d+)?)+$"
LEAST_MEDIAN, MOST_SIZES, MOST_UNNAMED = 30, 0.3, 0.5


def by_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ids are wanted (id)."""
    return rows.join(wanted.select("id").distinct(), "id", "left_semi")


def keep_species(rows: DataFrame, species: list[str]) -> DataFrame:
    return rows.filter(F.col("species").isNull() | F.col("species").isin(species))


def not_ignored(rows: DataFrame, *names: str) -> DataFrame:
    """Rows none of whose names is that of a builder whose lists are left alone."""
    return rows.filter(~reduce(lambda a, b: a | b, [builder_key(F.col(c)).isin(IGNORED) for c in names]))


def filled_parts(rows: DataFrame) -> DataFrame:
    """Rows without a part number get their description as one: a code as it is, else its first 48 characters."""
    desc = F.trim(F.coalesce("description", F.lit("")))
    code = F.when(F.upper(desc).startswith("LA-"), F.upper(desc)).otherwise(desc)
    made = F.when(is_item_code(desc), code).otherwise(F.trim(F.substring(squeeze(desc), 1, 48)))
    empty = F.trim(F.coalesce("part_number", F.lit(""))) == ""
    return rows.withColumn("part_number", F.when(empty & (made != ""), made).otherwise(F.col("part_number")))


def low_quality(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, low): whether a reading's rows look wrong: low median price, sizes for parts, or columns without a name for woods."""
    share = lambda c, p: F.avg(F.when(F.coalesce(F.col(c).rlike(p), F.lit(False)), 1.0).otherwise(0.0))
    low = (F.median("base_price") < LEAST_MEDIAN) | (share("part_number", SIZE_LIKE) > MOST_SIZES) | (share("species", r"(?i)^col_\d+$") > MOST_UNNAMED)
    return rows.groupBy(*keys).agg(F.coalesce(low, F.lit(True)).alias("low"))


def best_rows(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Of rows with equal part, finish, price and wood the one that says most; of equal part, finish and price those without a wood only if none has one, and then one."""
    text = lambda c: F.coalesce(c, F.lit(""))
    keyed = rows.withColumn("_key", F.struct(text("part_number").alias("p"), text("finish_state").alias("f"), F.round(F.coalesce("base_price", F.lit(0.0)), 2).alias("b"))).withColumn("_wood", text("species"))
    score = F.struct((text("collection") != "").cast("int").alias("c"), F.length(text("description")).alias("d"), (-F.col("id")).alias("i"))
    keyed = dealt(keyed.withColumn("_part", F.xxhash64("_key")), parts, "_part")
    best = keyed.groupBy("_part", "_key", "_wood").agg(F.max_by(F.struct(*rows.columns), score).alias("_row"))
    # a wood of a key, if it has any
    most = F.max("_wood").over(Window.partitionBy("_part", "_key"))
    kept = best.withColumn("_most", most).filter((F.col("_wood") != "") | (F.col("_most") == ""))
    return kept.select("_row.*")


def first_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of the keys, nulls alike; of every other column the first value by id that is not null."""
    rest = [c for c in rows.columns if c not in keys and c != "id"]
    return rows.groupBy(*keys).agg(F.min("id").alias("id"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in rest])


def exact_duplicates(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(n_groups): how many groups of rows are equal in vendor, part, wood, finish, description and price."""
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("vendor", "part_number", "species", "finish_state", "description")]
    keyed = rows.select(*keys, F.round(F.coalesce("base_price", F.lit(0.0)), 2).alias("price"))
    groups = dealt(keyed, parts, "vendor", "part_number", "species", "finish_state").groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("n_groups"))


def batch_totals(files: DataFrame) -> DataFrame:
    """(ok, errors, n_rows) of a batch of files (status, total)."""
    return files.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"), F.coalesce(F.sum("total"), F.lit(0)).alias("n_rows"))


def effective_multiplier(saved: Column, average: Column, default: Column) -> Column:
    return F.coalesce(saved, F.when(average != 0, average), default)


def matched_users(incoming: DataFrame, users: DataFrame) -> DataFrame:
    """incoming (guid, name) with the user_id of a user (user_id, guid, name, display): by guid, else by either name without regard to case, the least id of several."""
    by_guid = users.filter("guid is not null").groupBy("guid").agg(F.min("user_id").alias("_by_guid"))
    names = users.select("user_id", F.explode(F.array(F.lower("name"), F.lower("display"))).alias("_name")).filter("_name is not null")
    by_name = names.groupBy("_name").agg(F.min("user_id").alias("_by_name"))
    out = incoming.join(by_guid, "guid", "left").join(by_name, F.lower(incoming["name"]) == F.col("_name"), "left")
    return out.select(*incoming.columns, F.coalesce("_by_guid", "_by_name").alias("user_id"))


def merged_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """Integrations (name, ok, at, last_ok, message) after new reports (name, ok, at, message): a failure keeps the time of the last success."""
    n = new.select("name", F.col("ok").alias("_ok"), F.col("at").alias("_at"), F.col("message").alias("_message"))
    out = old.join(n, "name", "full_outer")
    last = F.when(F.col("_ok"), F.col("_at")).otherwise(F.col("last_ok"))
    return out.select("name", F.coalesce("_ok", "ok").alias("ok"), F.coalesce("_at", "at").alias("at"), last.alias("last_ok"), F.when(F.col("_at").isNotNull(), F.col("_message")).otherwise(F.col("message")).alias("message"))


def distinct_in_order(x: Column) -> Column:
    return F.array_distinct(x)
