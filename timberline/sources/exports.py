"""Catalog and quote rows as files and as payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import department, latin

# Column headings of exports.
HEADINGS = {"vendor": "Builder", "collection": "Collection", "part_number": "Part #", "description": "Description", "dimensions": "Dimensions", "option_key": "Option", "species": "Wood", "finish_state": "Finish", "base_price": "Wholesale", "multiplier": "Multiplier", "adjusted_price": "Retail", "unit": "Unit", "notes": "Notes", "source_file": "Source"}


def to_csv(rows: DataFrame, path: str) -> None:
    """Writes rows without ids as CSV with a header, in as many files as rows has partitions."""
    rows.drop("id").write.mode("overwrite").option("header", True).csv(path)


def headed(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(h) for c, h in HEADINGS.items() if c in rows.columns])


def printable(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Text columns cut to the characters that fit a printed width, in Latin-1."""

    def fit(c: str, width: int) -> Column:
        most = int(width / 1.6)
        s = latin(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("."))).otherwise(s).alias(c)

    return rows.select(*[fit(c, w) for c, w in widths.items()])


def payloads(lines: DataFrame, vendors: dict[str, str] | None = None) -> DataFrame:
    """(quote_id, payload): the lines of each quote as JSON, in the order of their numbers."""
    mapped = F.upper("vendor") if not vendors else F.coalesce(F.create_map(*[F.lit(x) for k, v in vendors.items() for x in (k.lower(), v)])[F.lower("vendor")], F.upper("vendor"))
    qty = F.when(F.col("qty") == F.floor("qty"), F.col("qty").cast("long").cast("string")).otherwise(F.col("qty").cast("string"))
    line = F.struct("line_no", mapped.alias("vendor"), department(F.lit(""), F.col("description")).alias("category"), F.concat_ws(" | ", "part_number", "description").alias("text"), qty.alias("qty"), "unit_retail", "line_total")
    return lines.groupBy("quote_id").agg(F.to_json(F.array_sort(F.collect_list(line))).alias("payload"))
