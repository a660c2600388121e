"""Prices and percentages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier where none is known.
DEFAULT_MULTIPLIER = 2.7


def cents(x: Column) -> Column:
    """Rounded half up to two places, by way of a decimal, so that engines agree."""
    return F.round(x.cast("decimal(18,6)"), 2).cast("double")


def exact_mean(x: Column) -> Column:
    """Mean by way of a decimal sum; does not depend on the order of rows."""
    return F.sum(x.cast("decimal(18,6)")).cast("double") / F.count(x)


def even_dollar(x: Column) -> Column:
    """Next even whole dollar at or above x; 0 for x <= 0, null for null, NaN and infinities."""
    x = x.cast("double")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x.isNull() | odd, F.lit(None)).when(x <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.ceil(x / 2.0 - 1e-12))


def retail(wholesale: Column, multiplier: Column) -> Column:
    """Wholesale times multiplier, to the next even dollar; null if either is null."""
    return even_dollar(wholesale * multiplier)


def multiplier_of(workbook: Column, prefer_workbook: Column, saved: Column, default: Column) -> Column:
    """The workbook's multiplier if preferred, else the saved one if positive, else the default."""
    return F.coalesce(F.when(prefer_workbook & (workbook > 0), workbook), F.when(saved > 0, saved), default)


def loose_number(text: Column) -> Column:
    """A number from text: without $, commas and blanks, else the first number within it; null if there is none."""
    bare = F.regexp_replace(text, r"[$,\s]", "")
    return F.coalesce(bare.try_cast("double"), F.nullif(F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double"))


def cell_price(text: Column) -> Column:
    """A price in a cell: no letters, above 0, at most 5,000,000; else null."""
    bare = F.regexp_replace(text, r"[$,\s]", "")
    value = F.when(~bare.rlike("[A-Za-z]"), bare.try_cast("double"))
    return F.when((value > 0) & (value <= 5_000_000), value)


def fraction(x: Column) -> Column:
    """A percentage as a fraction: negative is null, above 1.5 means whole percents."""
    value = F.regexp_replace(x.cast("string"), "%", "").try_cast("double")
    return F.when(value < 0, F.lit(None)).when(value > 1.5, value / 100.0).otherwise(value)


def line_total(quantity: Column, unit: Column, discount_percent: Column) -> Column:
    zero = F.lit(0.0)
    return cents(F.coalesce(quantity, zero) * F.coalesce(unit, zero) * (1.0 - F.coalesce(discount_percent, zero) / 100.0))
