"""Repricing, vendor settings and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents, line_total, retail
from .rollups import is_item


def reprice(rows: DataFrame, settings: DataFrame, items_only: bool = True) -> DataFrame:
    """Rows of vendors with a saved multiplier (name, multiplier) get it, and the retail price that follows; all others stay as they are."""
    saved = settings.select(F.col("name").alias("vendor"), F.col("multiplier").alias("_m")).filter("_m > 0")
    hit = F.col("_m").isNotNull() & F.col("base_price").isNotNull() & (is_item() if items_only else F.lit(True))
    out = rows.join(saved, "vendor", "left")
    out = out.withColumn("adjusted_price", F.when(hit, retail(F.col("base_price"), F.col("_m"))).otherwise(F.col("adjusted_price")))
    return out.withColumn("multiplier", F.when(hit, F.col("_m")).otherwise(F.col("multiplier"))).select(*rows.columns)


def recompute(rows: DataFrame) -> DataFrame:
    """Retail prices from each row's own multiplier."""
    return rows.withColumn("adjusted_price", F.when(F.col("base_price").isNotNull(), retail(F.col("base_price"), F.col("multiplier"))).otherwise(F.col("adjusted_price")))


def merged_settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vendor settings (name, multiplier, phone); new values replace old ones where they are not null."""
    both = old.alias("o").join(new.alias("n"), F.col("o.name") == F.col("n.name"), "full_outer")
    return both.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("name", "multiplier", "phone")])


def orphans_removed(settings: DataFrame, rows: DataFrame) -> DataFrame:
    return settings.join(rows.filter("vendor is not null").select(F.col("vendor").alias("name")).distinct(), "name", "left_semi")


def totals(lines: DataFrame, quotes: DataFrame) -> DataFrame:
    """Of each quote (quote_id, discount_pct, tax_pct): subtotal, discount, tax, total and number of lines (quote_id, line_total)."""
    by = lines.groupBy("quote_id").agg(F.sum(F.col("line_total").cast("decimal(18,2)")).alias("s"), F.count(F.lit(1)).alias("line_count"))
    out = quotes.join(by, "quote_id", "left")
    zero = F.lit(0.0)
    out = out.withColumn("subtotal", F.coalesce(F.col("s").cast("double"), zero)).withColumn("_left", cents(F.col("subtotal") * (1.0 - F.coalesce("discount_pct", zero) / 100.0)))
    out = out.withColumn("tax_amount", cents(F.col("_left") * (F.coalesce("tax_pct", zero) / 100.0)))
    return out.select("quote_id", "subtotal", cents(F.col("subtotal") - F.col("_left")).alias("discount_amount"), "tax_amount", cents(F.col("_left") + F.col("tax_amount")).alias("grand_total"), F.coalesce("line_count", F.lit(0)).alias("line_count"))


def numbered(lines: DataFrame, last: DataFrame, *order: Column) -> DataFrame:
    """New lines numbered on from the last number (quote_id, line_no) of their quote."""
    w = Window.partitionBy("quote_id").orderBy(*order)
    last = last.groupBy("quote_id").agg(F.max("line_no").alias("_last"))
    return lines.join(last, "quote_id", "left").withColumn("line_no", (F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("_last")


def quote_lines(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """Lines (quote_id, id, qty, unit_retail?, line_discount_pct?) joined to catalog rows; a given price wins over the catalog's."""
    c = rows.select("id", "vendor", "part_number", "description", F.col("adjusted_price").alias("_retail"))
    out = wanted.join(c, "id").withColumn("unit_retail", F.coalesce("unit_retail", "_retail")).drop("_retail")
    return out.withColumn("line_total", line_total(F.col("qty"), F.col("unit_retail"), F.col("line_discount_pct")))
