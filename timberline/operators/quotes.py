"""Quotes and their lines as new tables, and what is handed on of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import line_total

#: What may be changed of a quote and of a line.
QUOTE_FIELDS = ["customer", "status", "notes", "discount_pct", "tax_pct"]
LINE_FIELDS = ["quantity", "unit_price", "discount_pct", "species", "finish_state", "notes", "description"]


def changed(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the values of `changes` (key and some fields) where these are not null; other columns of changes are refused."""
    if other := set(changes.columns) - {key, *fields}:
        raise ValueError(f"not to be changed: {', '.join(sorted(other))}")
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    out = rows.join(new, F.col(key) == F.col("_key"), "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in rows.columns])


def recalculated(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line_total", line_total(F.col("quantity"), F.col("unit_price"), F.col("discount_pct")))


def changed_lines(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Lines with changes and new totals."""
    return recalculated(changed(lines, changes, "line_id", LINE_FIELDS))


def removed(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def new_lines(lines: DataFrame, present: DataFrame) -> DataFrame:
    """Lines that the other system does not have yet, by quote, part and quantity."""
    return lines.join(present.select("quote_id", "part_number", "quantity").distinct(), ["quote_id", "part_number", "quantity"], "left_anti")


def payloads(lines: DataFrame) -> DataFrame:
    """(quote_id, n_lines, payload): the lines of each quote in their order as JSON; a quote's lines are few."""
    line = F.struct("line_no", "part_number", "quantity", "unit_price")
    return lines.groupBy("quote_id").agg(F.count(F.lit(1)).alias("n_lines"), F.to_json(F.sort_array(F.collect_list(line))).alias("payload"))


def retail_preview(rows: DataFrame) -> DataFrame:
    """What a short list shows of catalog rows: names, wood, finish and the price to the customer."""
    return rows.select("id", F.col("vendor").alias("builder"), F.col("part_number").alias("part"), "description", F.col("species").alias("wood"), F.col("finish_state").alias("finish"), F.col("adjusted_price").alias("retail"))


def wholesale_view(rows: DataFrame) -> DataFrame:
    """Parsed rows without prices to the customer."""
    return rows.drop("adjusted_price", "multiplier")


def bound(rows: DataFrame, vendor: str, multiplier: float) -> DataFrame:
    """Parsed rows as those of a builder, with its multiplier."""
    return rows.withColumn("vendor", F.lit(vendor)).withColumn("multiplier", F.lit(multiplier))
