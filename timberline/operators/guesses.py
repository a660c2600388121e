"""What the columns of a sheet hold, judged by their values.

A sheet's columns are rows (sheet, row, col, value); value is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cell_price
from ..functions.text import lookup, squeeze
from .cells import header_kind
from .sheets import assigned

# Codes, amounts and labels as cells, and how many rows are looked at.
CODE = r"(?i)^[A-Z0-9][A-Z0-9\-_/]{1,20}$"
AMOUNT = r"^\$?\s*[\d,]+(?:\.\d{1,2})?$"
LABEL = r"(?i)^(page\s*#?|item\s*#?|description|size)$"
ROWS_FOR_PRICE, ROWS_FOR_CODE, ROWS_FOR_RATIO = 50, 25, 40
PRICE_SHARE, RATIO_ERROR, LEAST_MARKUP = 0.45, 0.08, 1.2

# Names of columns of a flat sheet, the first that a sheet has counts.
ALIASES = {
    "part_number": ["part_number", "part number", "part #", "part#", "part no", "part no.", "sku", "item", "item #", "item number", "item no", "item no.", "style", "style #", "style number", "model", "model #", "code", "catalog #", "catalog number", "stock #", "item name"],
    "description": ["description", "desc", "item description", "product", "product name", "name", "title", "product description", "descr."],
    "species": ["species", "wood", "wood species", "finish wood", "material", "wood type", "species/finish"],
    "base_price": ["base_price", "base price", "price", "wholesale", "wholesale price", "net price", "net", "dealer price", "dealer", "cost", "unit price", "list price", "your price", "amount", "retail", "msrp", "wholesale $", "price $", "net $", "whsl. price", "regular"],
    "unit": ["unit", "uom", "um", "each", "units"],
    "collection": ["collection", "series", "line", "product line", "category", "group", "family", "brand", "manufacturer"],
    "notes": ["notes", "note", "comments", "comment", "remarks", "options"],
    "dimensions": ["dimensions", "dimension", "dims", "size", "w x d x h", "overall size"],
    "vendor": ["vendor", "builder", "supplier", "manufacturer name"],
}


def _values(cells: DataFrame, rows: int) -> DataFrame:
    """The cells of a column's first rows, numbered from 0, that are not empty."""
    return cells.withColumn("value", squeeze(F.col("value"))).filter((F.col("row") < rows) & (F.col("value") != ""))


def _without(columns: DataFrame, headers: DataFrame | None, kinds: list[str]) -> DataFrame:
    """columns (sheet, col, ...) without those whose header (sheet, col, name) is of one of the kinds."""
    if headers is None:
        return columns
    kind = header_kind(F.regexp_replace("name", r"\s*\(\d+\)$", ""))
    return columns.join(headers.filter(kind.isin(kinds)).select("sheet", "col"), ["sheet", "col"], "left_anti")


def price_columns(cells: DataFrame, least: int = 3) -> DataFrame:
    """(sheet, col) of columns of which enough cells, and a share of them, are prices."""
    seen = _values(cells, ROWS_FOR_PRICE).groupBy("sheet", "col").agg(F.count(F.lit(1)).alias("n"), F.count(cell_price(F.col("value"))).alias("hits"))
    return seen.filter((F.col("hits") >= least) & (F.col("hits") / F.col("n") >= PRICE_SHARE)).select("sheet", "col")


def code_columns(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(sheet, col): the first column of each sheet that holds item codes and isn't headed by a wood; headers: (sheet, col, name)."""
    code = F.col("value").rlike(CODE) & ~F.col("value").rlike(AMOUNT)
    seen = _values(cells, ROWS_FOR_CODE).groupBy("sheet", "col").agg(F.count(F.lit(1)).alias("n"), F.count_if(code).alias("hits"))
    return _without(seen.filter("n >= 3 and hits >= 3"), headers, ["species", "skip"]).groupBy("sheet").agg(F.min("col").alias("col"))


def name_columns(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(sheet, col, hits): the column of each sheet with most values that look like names of products, the first of equals; none that is headed by a wood, finish, size or price."""
    v = F.col("value")
    name = ~v.rlike(AMOUNT) & ~v.rlike(r"^[\d.]+$") & (F.length(v) >= 3) & (v.contains(" ") | (F.length(v) >= 8) | v.rlike("^[A-Za-z].*[A-Za-z]$")) & ~v.rlike(LABEL)
    seen = _values(cells, ROWS_FOR_PRICE).groupBy("sheet", "col").agg(F.count(F.lit(1)).alias("n"), F.count_if(name).alias("hits")).filter("n >= 5 and hits >= 5")
    best = _without(seen, headers, ["species", "finish", "finish_est", "dim", "price", "skip"]).join(price_columns(cells, 6), ["sheet", "col"], "left_anti").groupBy("sheet").agg(F.max(F.struct("hits", (-F.col("col")).alias("place"))).alias("top"))
    return best.select("sheet", (-F.col("top.place")).alias("col"), "top.hits")


def wholesale_columns(cells: DataFrame, species: DataFrame, markup: float, headers: DataFrame | None = None) -> DataFrame:
    """(sheet, col, wholesale): for the marked-up columns of `species` (sheet, col), in their order, the free price column beside them whose median ratio is nearest to the markup.

    A wholesale column serves one wood.  Columns headed as codes, names and
    sizes are none; headers: (sheet, col, name).
    """
    if markup < LEAST_MARKUP:
        return species.select("sheet", "col", F.lit(None).cast("int").alias("wholesale")).limit(0)
    priced = _values(cells, ROWS_FOR_RATIO).withColumn("price", cell_price(F.col("value"))).filter("price is not null")
    marked = priced.join(species, ["sheet", "col"], "left_semi")
    plain = _without(price_columns(cells, 2).join(species, ["sheet", "col"], "left_anti"), headers, ["id", "desc", "dim"])
    plain = priced.join(plain, ["sheet", "col"], "left_semi")
    pairs = marked.alias("a").join(plain.alias("b"), ["sheet", "row"]).select("sheet", F.col("a.col").alias("col"), F.col("b.col").alias("wholesale"), (F.col("a.price") / F.col("b.price")).alias("ratio"))
    # forty rows a column at most
    median = F.element_at(F.sort_array(F.collect_list("ratio")), (F.floor(F.count("ratio") / 2) + 1).cast("int"))
    found = pairs.groupBy("sheet", "col", "wholesale").agg(F.count("ratio").alias("n"), median.alias("median")).filter("n >= 3")
    able = found.withColumn("error", F.abs(F.col("median") - markup) / markup).filter(F.col("error") < RATIO_ERROR)
    return assigned(able.select("sheet", "col", "wholesale", "error"), ["sheet"], "col", "wholesale", "error").drop("error")


def column_name(header: Column) -> Column:
    return squeeze(F.lower(header))


def mapped_columns(headers: DataFrame) -> DataFrame:
    """(sheet, field, header): which header of a sheet (sheet, header) names each field, by the order of ALIASES."""
    spark = headers.sparkSession
    known = spark.createDataFrame([(f, k, a) for f, names in ALIASES.items() for k, a in enumerate(names)], "field string, place int, name string")
    hits = headers.withColumn("name", column_name(F.col("header"))).join(F.broadcast(known), "name")  # a fixed list
    return hits.groupBy("sheet", "field").agg(F.min_by("header", "place").alias("header"))


def first_usable(headers: DataFrame, rows: int = 8, least: int = 2) -> DataFrame:
    """(sheet, row): the first of a sheet's rows that names enough fields; headers: (sheet, row, header)."""
    field = {a: f for f, names in reversed(ALIASES.items()) for a in names}
    hit = lookup(column_name(F.col("header")), field)
    seen = headers.filter(F.col("row") < rows).groupBy("sheet", "row").agg(F.count_distinct(hit).alias("n")).filter(F.col("n") >= least)
    return seen.groupBy("sheet").agg(F.min("row").alias("row"))
