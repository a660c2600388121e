"""Configurations that stand in the catalog more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MISSING
from ..plans.catalog import IDENTITY, dealt


def identity() -> Column:
    """A struct that is equal for rows of the same configuration: blanks and spelled nulls count as missing, case doesn't count."""

    def plain(c: str) -> Column:
        s = F.lower(F.trim(F.col(c).cast("string")))
        return F.when(s.isin("", *MISSING), F.lit("")).otherwise(F.coalesce(s, F.lit("")))

    return F.struct(*[plain(c).alias(c) for c in IDENTITY])


def is_identified() -> Column:
    key = identity()
    return F.concat(*[key[c] for c in IDENTITY]) != ""


def duplicate_groups(rows: DataFrame, limit: int = 100, parts: int | None = None) -> DataFrame:
    """Configurations with more than one row, the largest first; fields are the least of the group."""
    by = dealt(rows.select(*IDENTITY, identity().alias("_key")), parts, "_key").groupBy("_key").agg(*[F.min(c).alias(c) for c in IDENTITY], F.count(F.lit(1)).alias("dup_count"))
    return by.filter("dup_count > 1").orderBy(F.desc("dup_count"), *[F.col(c).asc_nulls_first() for c in IDENTITY]).select(*IDENTITY, "dup_count").limit(limit)


def newest_of_each(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows without older ones of the same configuration; rows without any identity all stay."""
    dated = F.coalesce("imported_at", F.lit("")) != ""
    keyed = rows.withColumn("_key", identity()).withColumn("_loose", F.when(is_identified(), F.lit(0)).otherwise(F.col("id")))
    order = Window.partitionBy("_key", "_loose").orderBy(dated.desc(), F.col("imported_at").desc_nulls_last(), F.col("id").desc())
    return dealt(keyed, parts, "_key", "_loose").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_key", "_loose")


def cleanup_report(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Groups and surplus rows that newest_of_each would remove."""
    by = dealt(rows.filter(is_identified()).select(identity().alias("_key")), parts, "_key").groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return by.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus"))


def last_of_exact(rows: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """The row of greatest id among rows that agree in keys and rounded wholesale price; one shuffle."""
    group = [F.coalesce(F.lower(F.trim(F.col(c))), F.lit("")).alias(f"_{c}") for c in keys] + [F.round("base_price", 2).alias("_price")]
    names = [f"_{c}" for c in keys]
    return dealt(rows.select("*", *group), parts, *names).groupBy(*names, "_price").agg(F.max(F.struct("id", *[c for c in rows.columns if c != "id"])).alias("_row")).select("_row.*")


def best_per(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order, with the number of rows it stands for."""
    w = Window.partitionBy(key)
    return rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("n_candidates", F.count(F.lit(1)).over(w)).filter("_n = 1").drop("_n")


def file_order(name: Column, size: Column) -> list[Column]:
    """Order in which price files of one builder are preferred."""
    n = F.lower(name)

    def worth(hit: Column, points: int) -> Column:
        return F.when(hit, points).otherwise(0)

    score = worth(n.rlike("level.?one|one.?blue"), 1000) + worth(n.rlike("level.?two|two.?orange"), -1000) + worth(n.contains("wholesale"), 50) + worth(n.rlike(r"20\d{2}"), 30) + worth(n.contains("master"), 20) + worth(n.contains("retail") & ~n.contains("wholesale"), -10) + worth(n.contains("footer"), -8)
    kind = F.when(n.endswith(".xlsx"), 3).when(n.endswith(".xlsm"), 2).when(n.endswith(".xls"), 1).otherwise(0)
    return [score.desc(), kind.desc(), size.desc(), name.asc()]
