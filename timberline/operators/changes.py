"""Changes of whole tables: what differs between two states of the catalog, standardising in place, replacements that are guarded by their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import DEFAULT_MULTIPLIER
from ..functions.text import VENDORS, lookup
from ..plans.catalog import COLUMNS, conform
from .pricing import orphans_removed
from .writes import marked, standardized, with_ids

#: A new list needs so many rows; where the old one has more than LARGE, at least FLOOR and so great a share of them.
LEAST, LARGE, FLOOR, SHARE = 5, 200, 30, 0.05
TOLERANCE = 1e-9


def _differs(a: Column, b: Column, kind: str, tolerance: float) -> Column:
    """Whether two values differ; nothing, a blank and 0 are one."""
    if kind in ("double", "float") or kind.startswith("decimal"):
        none = F.lit(0.0)
        return F.abs(F.coalesce(a, none) - F.coalesce(b, none)) >= tolerance
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return ~F.coalesce(a, F.lit(0)).eqNullSafe(F.coalesce(b, F.lit(0)))
    return ~F.coalesce(a.cast("string"), F.lit("")).eqNullSafe(F.coalesce(b.cast("string"), F.lit("")))


def _fields(old: str, new: str, kinds: dict[str, str], columns: list[str], tolerance: float) -> Column:
    """By name the columns in which two structs of a row differ."""
    return F.array_compact(F.array(*[F.when(_differs(F.col(f"{old}.{c}"), F.col(f"{new}.{c}"), kinds[c], tolerance), F.lit(c)) for c in columns]))


def differences(old: DataFrame, new: DataFrame, key: str = "id", columns: list[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, status, fields) of every row of either table: kept, changed (in which fields, by name), dropped or added.

    Each side is dealt out by its key once.  Numbers that differ by less than
    `tolerance` are equal.  A key stands once in each table; rows without one
    match nothing: old ones are dropped, new ones added.
    """
    kinds = dict(old.dtypes)
    columns = sorted(c for c in (columns or old.columns) if c != key)
    o = old.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.struct(*columns).alias("_o"))
    n = new.filter(F.col(key).isNotNull()).select(F.col(key).alias("_j"), F.struct(*columns).alias("_n"))
    both = o.join(n, F.col("_k") == F.col("_j"), "full_outer")
    changed = _fields("_o", "_n", kinds, columns, tolerance)
    status = F.when(F.col("_n").isNull(), "dropped").when(F.col("_o").isNull(), "added").when(F.size("fields") > 0, "changed").otherwise("kept")
    fields = F.when(F.col("_n").isNotNull() & F.col("_o").isNotNull(), changed).otherwise(F.array().cast("array<string>"))
    out = both.select(F.coalesce("_k", "_j").alias(key), fields.alias("fields"), "_o", "_n").select(key, status.alias("status"), "fields")
    none = F.array().cast("array<string>")
    loose = [t.filter(F.col(key).isNull()).select(key, F.lit(s).alias("status"), none.alias("fields")) for t, s in ((old, "dropped"), (new, "added"))]
    return out.union(loose[0]).union(loose[1])


def counts(different: DataFrame) -> DataFrame:
    """(scanned, kept, updated, dropped) of differences() from a table to its cleaned form."""
    is_ = lambda *names: F.count_if(F.col("status").isin(*names))
    return different.agg(is_("kept", "changed", "dropped").alias("scanned"), is_("kept", "changed").alias("kept"), is_("changed").alias("updated"), is_("dropped").alias("dropped"))


def field_counts(different: DataFrame) -> DataFrame:
    """(field, n): how many rows changed in each field."""
    return different.select(F.explode("fields").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def renamed_settings(settings: DataFrame) -> DataFrame:
    """Vendor settings (name, ...) under the vendors' canonical names; where several come to one name, the one that had it, else the first."""
    rest = [c for c in settings.columns if c != "name"]
    named = settings.withColumn("_to", F.coalesce(lookup(F.lower("name"), VENDORS), F.col("name")))
    best = F.min_by(F.struct(*rest), F.struct((F.col("name") != F.col("_to")).alias("_other"), "name"))
    return named.groupBy("_to").agg(best.alias("_b")).select(F.col("_to").alias("name"), *[F.col(f"_b.{c}") for c in rest])


def standardized_in_place(rows: DataFrame, settings: DataFrame, default_multiplier: float = DEFAULT_MULTIPLIER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, settings, differences) after all rows are standardised: junk goes, settings are renamed, and those of vendors without rows go."""
    clean = standardized(rows, default_multiplier)
    return clean, orphans_removed(renamed_settings(settings), clean), _marked_differences(marked(rows, default_multiplier))


def _marked_differences(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """differences() by id from marked() rows as they were to those that stay; a row's two states stand side by side, so nothing is dealt out."""
    kinds = dict(rows.dtypes)
    fields = _fields("_was", "_now", kinds, sorted(c for c in COLUMNS if c != "id"), tolerance)
    none = F.array().cast("array<string>")
    known = F.col("id").isNotNull()
    both = rows.select("id", "_stays", "_was", F.struct(*COLUMNS).alias("_now"))
    seen = both.select("id", "_stays", F.when(F.col("_stays") & known, fields).otherwise(none).alias("fields"))
    # a row without an id matches nothing, not even itself
    status = F.when(~F.col("_stays") | ~known, "dropped").when(F.size("fields") > 0, "changed").otherwise("kept")
    statuses = F.when(F.col("_stays") & ~known, F.array(status, F.lit("added"))).otherwise(F.array(status))
    return seen.select("id", F.explode(statuses).alias("status"), "fields")


def replacement_plan(rows: DataFrame, new: DataFrame, least: int = LEAST, large: int = LARGE, floor: int = FLOOR, share: float = SHARE) -> DataFrame:
    """(vendor, existing, offered, status) of every vendor of the new rows: replaced, too_few or kept.

    A list of fewer than `least` rows was not read well; one that is small
    beside a large catalog is no reason to lose it.  One aggregate over both
    sides decides for all vendors.
    """
    sides = rows.select("vendor", F.lit(1).alias("_o"), F.lit(0).alias("_n")).union(new.select("vendor", F.lit(0), F.lit(1))).filter("vendor is not null")
    by = sides.groupBy("vendor").agg(F.sum("_o").alias("existing"), F.sum("_n").alias("offered")).filter("offered > 0")
    small = (F.col("existing") > large) & (F.col("offered") < F.greatest(F.lit(floor), F.floor(F.col("existing") * share)))
    return by.withColumn("status", F.when(F.col("offered") < least, "too_few").when(small, "kept").otherwise("replaced"))


def guarded_replacement(rows: DataFrame, new: DataFrame, **limits: float) -> DataFrame:
    """rows, those of every vendor whose new list is large enough replaced by it; new rows get ids above the old."""
    ok = replacement_plan(rows, new, **limits).filter("status = 'replaced'").select("vendor")
    last = rows.agg(F.max("id")).first()[0] or 0
    fresh = with_ids(conform(new.join(ok, "vendor", "left_semi")), last).select(*COLUMNS)
    return rows.select(*COLUMNS).join(ok, "vendor", "left_anti").select(*COLUMNS).unionByName(fresh)
