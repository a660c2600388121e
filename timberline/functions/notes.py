"""Texts of quotes, users and captions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text

# Size of a note's parts in captions; what parts a caption.
PART, DESCRIPTION, DOT = 28, 36, " · "


def role(label: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(s.contains("admin"), "admin").when(s.contains("warehouse"), "floor").otherwise("sales")


def described(part: Column, description: Column, collection: Column) -> Column:
    """A description made of collection and part where there is none besides the part."""
    bare = F.trim(F.regexp_replace(F.coalesce(collection, F.lit("")), "(?i)^mult-?", ""))
    made = F.when(part.rlike(r"(?i)^\d+(\.\d+)?\s*x\s*\d+"), F.concat(F.when(bare == "", "Bookcase").otherwise(bare), F.lit(" "), part))
    made = made.when(F.coalesce(collection, F.lit("")) != "", F.trim(F.concat_ws(" ", bare, part))).otherwise(part)
    return F.when((F.coalesce(part, F.lit("")) != "") & ((F.coalesce(description, F.lit("")) == "") | (description == part)), made).otherwise(description)


def sheet_collection(title: Column, sheet: Column) -> Column:
    """A collection's name from a title, else from the sheet's name."""

    def one(x: Column) -> Column:
        s = F.trim(F.regexp_replace(clean_text(x), r"(?i)\s*collection\s*$", ""))
        return F.when((s != "") & ~s.rlike(r"(?i)available\s+in|we\s*carry"), F.substring(s, 1, 80))

    return F.coalesce(one(title), one(sheet), clean_text(sheet), F.lit("Casegoods"))


def stained(notes: Column, stain: Column) -> Column:
    """Notes of a line with this stain in place of the one they name."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(notes, F.lit("")), r"(?i)\s*Stain:\s*[^·|\n]*", ""), r"^[ ·|\n]+|[ ·|\n]+$", "")
    has = F.coalesce(stain, F.lit("")) != ""
    return F.when(has & (bare != ""), F.concat(bare, F.lit(DOT + "Stain: "), stain)).when(has, F.concat(F.lit("Stain: "), stain)).otherwise(bare)


def headed(notes: Column, wood: Column, stain: Column, finish: Column) -> Column:
    """Notes of a quote with a line for each of wood, stain and finish, in place of those that they have."""
    bare = F.trim(F.coalesce(notes, F.lit("")))
    lines = []
    for name, value in (("Wood", wood), ("Stain", stain), ("Finish", finish)):
        bare = F.regexp_replace(F.regexp_replace(bare, f"(?im)^{name}:.*$", ""), r"^\s+|\s+$", "")
        lines.append(F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value)))
    made = F.concat_ws("\n", *lines)
    return F.regexp_replace(F.concat(bare, F.lit("\n"), made), r"^\s+|\s+$", "")


def caption(id_: Column, part: Column, price: Column, description: Column) -> Column:
    cut = lambda x, n: F.substring(F.coalesce(x, F.lit("")), 1, n)
    return F.concat(F.lit("#"), id_.cast("string"), F.lit(DOT), cut(part, PART), F.lit(DOT + "$"), F.format_number(F.coalesce(price, F.lit(0.0)), 0), F.lit(DOT), cut(description, DESCRIPTION))


def quantity_text(x: Column) -> Column:
    """A whole quantity without decimals, any other as it is."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def money_text(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.coalesce(x, F.lit(0.0)), 2))


def quote_number(at: Column) -> Column:
    return F.concat(F.lit("Q-"), F.date_format(at, "yyyyMMdd-HHmmss"))


def batch_key(*parts: Column) -> Column:
    """A short name for a set of uploads: the first half of a digest of what identifies it."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def password_digest(x: Column) -> Column:
    """The stored form of a password as older tables hold it; unsalted, so only for reading those."""
    return F.sha2(F.coalesce(x, F.lit("")).cast("binary"), 256)
