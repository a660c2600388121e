"""Catalog changes as new tables: replace, delete, append, upsert, standardise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.money import DEFAULT_MULTIPLIER, cents, retail
from ..plans.catalog import COLUMNS, conform
from .duplicates import identity, is_identified


def with_ids(rows: DataFrame, last: Column | int) -> DataFrame:
    """Rows with ids above `last`, unique but not dense; no global order is needed."""
    return rows.withColumn("id", F.monotonically_increasing_id() + 1 + last)


def replace(rows: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """rows without those whose `column` is `value`, and the new rows, if there are any."""
    return append(delete(rows, column, value), new)


def replaced_counts(rows: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """(deleted, inserted, total) of replace()."""
    gone = rows.agg(F.count_if(F.col(column).eqNullSafe(value)).alias("deleted"))
    return gone.crossJoin(new.agg(F.count(F.lit(1)).alias("inserted"))).select("deleted", "inserted", F.col("inserted").alias("total"))  # one row each


def added(rows: DataFrame, new: DataFrame, mode: str = "append") -> DataFrame:
    """rows after new ones, all of the builder that the first of them by id names.

    Modes: replace_vendor (also replace_builder, replace_source) puts them in
    place of all rows of the builder, or of the source file if no builder is
    named; upsert; append.
    """
    if mode not in ("append", "upsert", "replace_vendor", "replace_builder", "replace_source"):
        raise ValueError(f"no such mode: {mode}")
    first = new.select(F.coalesce(text.vendor(F.col("vendor"), F.col("source_file")), "vendor").alias("vendor"), "source_file", "id").orderBy("id").first()
    if first is None:
        return conform(rows)
    new = new.withColumn("vendor", F.lit(first["vendor"]))
    if mode == "upsert":
        return upsert(rows, new).select(*COLUMNS)
    if mode == "append":
        return append(rows, new)
    if first["vendor"]:
        return replace(rows, new, "vendor", first["vendor"])
    return replace(rows, new, "source_file", first["source_file"]) if first["source_file"] else append(rows, new)


def delete(rows: DataFrame, column: str, value: str) -> DataFrame:
    """rows without those whose `column` is `value`, which must not be empty."""
    if not value:
        raise ValueError("what is deleted must be named")
    return rows.filter(~F.col(column).eqNullSafe(value))


def append(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(conform(new))


#: A new null keeps the old value of these; the others of VALUES are overwritten.
KEPT = ["description", "price_basis", "unit", "notes", "species_tier", "line_kind", "addon_pct"]
VALUES = [*KEPT, "base_price", "multiplier", "adjusted_price", "source_file", "imported_at"]


def upsert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows updated and extended by new ones, with a column `change`: kept, updated or inserted.

    Of new rows with one configuration the first by id counts; new rows without
    price, part and description are skipped; those without identity are added.
    An old configuration that occurs twice is updated in its row of greatest id.
    """
    usable = new.filter(F.col("base_price").isNotNull() | (F.coalesce("part_number", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != ""))
    usable = usable.withColumn("_key", identity()).withColumn("_known", is_identified())
    loose = usable.filter(~F.col("_known"))
    first = Window.partitionBy("_key").orderBy("id")
    keyed = usable.filter("_known").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    # only the last row of a configuration can be met; the others and those without identity stay out of the join
    known = rows.filter(is_identified()).withColumn("_key", identity()).withColumn("_last", F.max("id").over(Window.partitionBy("_key")))
    top = F.coalesce(F.col("id") == F.col("_last"), F.lit(False))
    both = known.filter(top).alias("o").join(keyed.alias("n"), F.col("o._key") == F.col("n._key"), "full_outer")
    hit = F.col("n._key").isNotNull()

    def value(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c not in VALUES:
            return F.coalesce(o, n)
        return F.coalesce(n, o) if c in KEPT else F.when(hit, n).otherwise(o)

    change = F.when(F.col("o._key").isNull(), "inserted").when(hit, "updated").otherwise("kept")
    merged = both.select(*[value(c).alias(c) for c in COLUMNS], change.alias("change"))
    rest = known.filter(~top).select(*COLUMNS).unionByName(rows.filter(~is_identified()).select(*COLUMNS))
    return merged.unionByName(rest.withColumn("change", F.lit("kept"))).unionByName(loose.select(*COLUMNS, F.lit("inserted").alias("change")))


def changes(upserted: DataFrame) -> DataFrame:
    return upserted.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def addon(vendor: str, label: str, flat: float | None = None, pct: float | None = None) -> dict:
    """A catalog row for a charge; it needs a label and a flat price or a percentage."""
    if not label.strip() or (flat is None and pct is None):
        raise ValueError("a charge needs a label and a price or a percentage")
    return {"vendor": vendor, "collection": "Addons", "part_number": label.strip(), "description": label.strip(), "option_key": label.strip(), "base_price": flat, "addon_pct": pct, "line_kind": "addon", "price_basis": "wholesale", "finish_state": "finished"}


# Fixed value: banners of new products.
NEW_BANNER = r"(?i)^(new(\s*product|\s*items?)?$|new\s+(january|february|march|april|may|june|july|august|september|october|november|december)\b)"


def _looked_up(rows: DataFrame, labels: DataFrame, name: str, clean: Column, of: str) -> DataFrame:
    """rows with `name`, what `clean` makes of the label in `of`; labels are few beside the rows, so each task gets them all and no row is dealt anew."""
    table = labels.select(F.col("_label").alias("_of"), clean.alias(name))
    return rows.join(F.broadcast(table), F.col(of) == F.col("_of"), "left").drop("_of")


def standardized(rows: DataFrame, default_multiplier: float = DEFAULT_MULTIPLIER) -> DataFrame:
    """Catalog rows with clean labels and prices; rows that name nothing or have no price go."""
    return marked(rows, default_multiplier, drop=True).select(*COLUMNS)


def marked(rows: DataFrame, default_multiplier: float = DEFAULT_MULTIPLIER, drop: bool = False) -> DataFrame:
    """All rows (with `drop`, those that stay) with clean labels and prices, as they were (_was, a struct), and whether they stay (_stays): not if they name nothing or have no price.

    Labels of woods, collections and vendors are cleaned once per distinct value:
    in place, their nested expressions would be copied into each other.  All
    are found in one pass.  A charge with a percentage needs no price.
    """
    r = conform(rows)
    labels = r.select(F.explode(F.array("vendor", "species", "collection")).alias("_label")).filter("_label is not null").distinct()
    label = F.col("_label")
    r = r.withColumn("_was", F.struct(*COLUMNS))
    r = _looked_up(_looked_up(r, labels, "_vendor", text.vendor(label), "vendor"), labels, "_wood", text.species(label), "species")
    stays: list[Column] = []

    def keep(r: DataFrame, on: Column) -> DataFrame:
        if drop:
            return r.filter(on)
        stays.append(F.col(f"_stays{len(stays)}"))
        return r.withColumn(f"_stays{len(stays) - 1}", F.coalesce(on, F.lit(False)))

    raw = F.coalesce("species", F.lit(""))
    cat = lambda c: F.nullif(F.concat(F.lit("Cat. "), F.regexp_extract(F.trim(c), r"(?i)^cat\.?\s*0*(\d+)$", 1)), F.lit("Cat. "))
    r = r.withColumn("_part", text.part(F.col("part_number"))).withColumn("_desc", text.clean_text(F.col("description"))).withColumn("_style", text.clean_text(F.col("collection")))
    fn = F.coalesce(F.col("_vendor") == "FN Chair", F.lit(False))
    r = keep(r, ~(fn & F.coalesce(F.col("source_file").rlike(r"(?i)level[\s_-]*two|two[\s_-]*orange"), F.lit(False))))
    tier = F.coalesce(cat(F.col("_part")), cat(F.col("_desc")))
    heal = fn & tier.isNotNull() & F.col("_style").isNotNull() & cat(F.col("_style")).isNull() & ~F.lower("_style").isin("seating", "price", "wholesale", "retail")
    own = cat(F.col("option_key"))
    good = fn & tier.isNull() & F.col("_part").isNotNull() & own.isNotNull()
    r = r.withColumn("_heal", F.coalesce(heal, F.lit(False))).withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_cat", F.when(F.col("_heal"), tier).when(F.col("_good"), own))
    dash = F.lit(" — ")
    r = r.withColumn("_part", F.when(F.col("_heal"), F.col("_style")).otherwise(F.col("_part")))
    r = r.withColumn("_desc", F.when(F.col("_heal") | (F.col("_good") & (F.col("_desc").isNull() | cat(F.col("_desc")).isNotNull())), F.concat("_part", dash, "_cat")).otherwise(F.col("_desc")))
    promote = F.col("_part").isNull() & text.is_item_code(F.col("_desc"))
    r = r.withColumn("_up", promote).withColumn("_part", F.when(F.col("_up"), F.col("_desc")).otherwise(F.col("_part"))).withColumn("_desc", F.when(F.col("_up"), F.lit(None)).otherwise(F.col("_desc")))
    r = keep(r, ~(text.is_junk_species(F.col("species")) & F.col("_wood").isNull()))
    size = F.coalesce(F.col("_wood").rlike(r"^[\d./\s×xX\-]+$"), F.lit(False))
    r = r.withColumn("_size", size).withColumn("dimensions", F.coalesce(text.clean_text(F.col("dimensions")), F.when(F.col("_size"), F.col("_wood")))).withColumn("_wood", F.when(~F.col("_size"), F.col("_wood")))
    tiered = F.coalesce(F.col("_wood").startswith("Wood Tier"), F.lit(False))
    said = text.finish(F.col("finish_state"))
    hinted = F.when(raw.rlike(r"(?i)unfinished|unf\b"), "unfinished").when(raw.rlike(r"(?i)\bfinished\b|\bfinshed\b") & (tiered | F.col("_wood").isNull()), "finished")
    r = r.withColumn("finish_state", F.when(tiered & F.trim(raw).rlike("(?i)^unf"), "unfinished").otherwise(F.coalesce(said, hinted, F.lit("finished"))))
    named = F.when(F.col("_heal") | F.col("_good"), F.lit(None).cast("string")).otherwise(F.col("collection"))
    r = r.withColumn("_named", named)
    # a vendor's own collection stands where none is left
    r = _looked_up(r, labels, "_coll", text.collection(label, F.lit(None).cast("string")), "_named").withColumn("_coll", F.coalesce("_coll", text.lookup(F.col("_vendor"), text.DEFAULT_COLLECTIONS)))
    premium = F.coalesce(F.col("_wood").rlike(r"(?i)\s*/\s*premium\s*$"), F.lit(False))
    r = r.withColumn("_premium", premium).withColumn("option_key", F.coalesce(text.clean_text(F.col("option_key")), "_cat", F.when(F.col("_premium"), F.lit("Premium"))))
    r = r.withColumn("_wood", F.when(F.col("_premium"), F.trim(F.regexp_replace("_wood", r"(?i)\s*/\s*premium\s*$", ""))).otherwise(F.col("_wood")))
    r = r.withColumn("_desc", F.coalesce("_desc", "_part")).withColumn("line_kind", F.when(F.lower(F.trim("line_kind")) == "addon", "addon").otherwise("item"))
    priced = (F.col("base_price") > 0) | ((F.col("line_kind") == "addon") & F.col("addon_pct").isNotNull())
    r = keep(r, F.coalesce(priced, F.lit(False)) & F.col("_desc").isNotNull() & ~F.col("_desc").rlike(NEW_BANNER))
    r = r.withColumn("multiplier", F.when(F.col("multiplier") > 0, F.col("multiplier")).otherwise(default_multiplier)).withColumn("base_price", F.when(F.col("base_price") > 0, cents(F.col("base_price"))))
    r = r.withColumn("species_tier", F.coalesce("species_tier", F.when(tiered, F.regexp_extract("_wood", r"(\d+)$", 1).try_cast("int"))))
    out = {"vendor": "_vendor", "part_number": "_part", "description": "_desc", "species": "_wood", "collection": "_coll"}
    for c, source in out.items():
        r = r.withColumn(c, F.col(source))
    for c in ("unit", "notes", "source_file"):
        r = r.withColumn(c, text.clean_text(F.col(c)))
    r = r.withColumn("price_basis", F.lit("wholesale")).withColumn("adjusted_price", retail(F.col("base_price"), F.col("multiplier")))
    return r.select(*COLUMNS, "_was", reduce(lambda a, b: a & b, stays, F.lit(True)).alias("_stays"))
