"""The catalog table: one row per sellable configuration, and a stand-in made of order lines."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import retail
from ..operators.running import dealt

COLUMNS = {
    "id": T.LongType(), "vendor": T.StringType(), "collection": T.StringType(), "part_number": T.StringType(),
    "description": T.StringType(), "dimensions": T.StringType(), "option_key": T.StringType(), "species": T.StringType(),
    "species_tier": T.IntegerType(), "finish_state": T.StringType(), "base_price": T.DoubleType(), "price_basis": T.StringType(),
    "multiplier": T.DoubleType(), "adjusted_price": T.DoubleType(), "unit": T.StringType(), "notes": T.StringType(),
    "source_file": T.StringType(), "imported_at": T.StringType(), "line_kind": T.StringType(), "addon_pct": T.DoubleType(),
}
SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in COLUMNS.items()])
#: What identifies a configuration; null and blank are equal, case doesn't count.
IDENTITY = ["vendor", "collection", "part_number", "species", "finish_state", "option_key", "dimensions"]
#: What a search term may stand in, besides prices.
SEARCHED = ["vendor", "collection", "part_number", "description", "species", "dimensions", "notes", "source_file", "finish_state", "option_key", "unit"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Catalog rows that one task sorts or groups at a time.
TASK_ROWS = 250_000


def parts_of(spark: SparkSession, sf_dir: str, name: str = "lineitem", rows: int = 1) -> int:
    """How many parts the catalog, or what holds so many rows a row of a table, is dealt to: they grow with the table, so that a task's share doesn't."""
    return max(spark.sparkContext.defaultParallelism, ceil(table(spark, sf_dir, name).count() * rows / TASK_ROWS))


def conform(rows: DataFrame) -> DataFrame:
    """rows with exactly the catalog's columns; absent ones are null, line_kind is `item` where absent or null."""
    have = set(rows.columns)
    out = rows.select(*[(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()])
    return out.withColumn("line_kind", F.coalesce("line_kind", F.lit("item")))


def price_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of all part and supplier pairs that were ever ordered."""
    # hardly any order line repeats a pair, so grouping before the shuffle would save nothing; the join on parts needs no other one
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus"), parts_of(spark, sf_dir), "l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linestatus").alias("status"))
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    rows = lines.join(part, lines["l_partkey"] == part["p_partkey"]).join(supplier, lines["l_suppkey"] == supplier["s_suppkey"])
    kind = F.col("p_partkey") % 4
    rows = rows.select(
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id"),
        F.col("s_name").alias("vendor"),
        F.col("p_type").alias("collection"),
        F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("part_number"),
        F.col("p_name").alias("description"),
        F.when(kind == 0, "Oak").when(kind == 1, "Oak / Brown Maple").when(kind == 2, "Cherry / Hard Maple / Hickory").otherwise("Bright Colors").alias("species"),
        (kind + 1).cast("int").alias("species_tier"),
        F.when(F.col("p_size") % 10 == 0, "Cat. 1").when(F.col("p_size") % 10 == 1, "Cat. 2").alias("option_key"),
        F.when(F.col("status") == "F", "finished").otherwise("unfinished").alias("finish_state"),
        F.col("p_retailprice").alias("base_price"),
        F.lit("wholesale").alias("price_basis"),
        F.when(F.col("s_suppkey") == 0, 1.7).otherwise(2.7).alias("multiplier"),
        F.concat(F.lit("list-"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".xlsx")).alias("source_file"),
        F.concat(F.lit("2026-0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("-01")).alias("imported_at"),
        F.when(F.col("p_size") == 50, "addon").otherwise("item").alias("line_kind"),
    )
    return conform(rows.withColumn("adjusted_price", retail(F.col("base_price"), F.col("multiplier"))))


#: The same rows in SQL that DuckDB reads.
PRICE_BOOK_SQL = """
lines as (select l_partkey, l_suppkey, min(l_linestatus) as status from lineitem group by l_partkey, l_suppkey),
book0 as (
  select l_partkey * 100000 + l_suppkey as id, s_name as vendor, p_type as collection,
    concat(p_brand, '-', cast(p_partkey as varchar)) as part_number, p_name as description, cast(null as varchar) as dimensions,
    case when p_size % 10 = 0 then 'Cat. 1' when p_size % 10 = 1 then 'Cat. 2' end as option_key,
    case p_partkey % 4 when 0 then 'Oak' when 1 then 'Oak / Brown Maple' when 2 then 'Cherry / Hard Maple / Hickory' else 'Bright Colors' end as species,
    cast(p_partkey % 4 + 1 as integer) as species_tier,
    case when status = 'F' then 'finished' else 'unfinished' end as finish_state, p_retailprice as base_price,
    'wholesale' as price_basis, case when s_suppkey = 0 then cast(1.7 as double) else cast(2.7 as double) end as multiplier,
    concat('list-', cast(s_suppkey % 7 as varchar), '.xlsx') as source_file,
    concat('2026-0', cast(p_partkey % 9 + 1 as varchar), '-01') as imported_at,
    case when p_size = 50 then 'addon' else 'item' end as line_kind, s_suppkey, p_partkey
  from lines join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey),
book as (
  select *, case when base_price * multiplier <= 0 then 0.0 else 2.0 * ceil(base_price * multiplier / 2.0 - cast(1e-12 as double)) end as adjusted_price from book0)
"""
