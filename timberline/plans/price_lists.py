"""Stand-ins for price lists, made of the parts: lines of pages, cells of sheets, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pages import PAGES
from ..operators.running import dealt, numbered, with_digests
from .catalog import parts_of, table

#: Parts of a page.
PAGE_PARTS = 12
#: Lines that a part has, about.
LINES_A_PART = 4
# Lines of a part, each with the condition under which it has it; k: its key, d: its price in whole dollars.
PART_LINES = [
    ("k % 9 = 0", "concat(upper(substring(p_type, 1, 1)), lower(substring(p_type, 2)), ' Chairs')"),
    ("k % 13 = 0", "'Brown  Maple Cherry Walnut'"),
    ("k % 17 = 0", "'Page 3'"),
    ("k % 10 = 3", "'12'"),
    ("k % 23 = 0", "'Solid'"),
    ("k % 6 = 0", "p_name"),
    ("k % 6 <> 0 and k % 5 <> 1", "concat(cast(5000 + k as string), ' ', p_name)"),
    ("k % 6 <> 0 and k % 5 = 1", "concat('SU-', cast(5000 + k as string), '  ', p_name)"),
    ("k % 5 = 0", "'SOLID'"),
    ("k % 19 = 0", "'Solid'"),
    ("k % 7 = 0", "'Leaves'"),
    ("k % 4 = 0 and k % 3 = 0", "cast(d as string)"),
    ("k % 4 = 0", "concat('$', cast(d as string))"),
    ("k % 4 = 0", "'N/A'"),
    ("k % 4 = 0 or k % 8 = 6", "concat('$1,', lpad(cast(k % 1000 as string), 3, '0'), '.50')"),
    ("k % 4 = 1", "concat('$', cast(d as string), '   N/A  $2,', lpad(cast(k % 1000 as string), 3, '0'))"),
    ("k % 4 = 1 and k % 3 = 1", "concat('$', cast(d as string), ' $', cast(d + 20 as string))"),
    ("k % 4 = 3 and k % 8 = 7", "concat('$ ', cast(d + 40 as string))"),
    ("k % 8 = 7", "'Rustic Walnut'"),
    ("k % 8 = 7", "concat('$ ', cast(d + 60 as string))"),
    ("k % 11 = 0", "concat('1 leaf extra $', cast(d % 90 as string))"),
]


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, page, line_no, line, block): a price list per brand, some lines a part; dealt by file and block."""
    parts = parts_of(spark, sf_dir, "part", LINES_A_PART)
    p = numbered(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "_r", parts)
    p = p.withColumn("page", (F.floor(F.col("_r") / PAGE_PARTS) + 1).cast("int")).withColumn("block", F.floor(F.col("page") / PAGES))
    p = dealt(p, parts, "p_brand", "block").withColumn("k", F.col("p_partkey")).withColumn("d", F.floor("p_retailprice").cast("long"))
    lines = F.array(*[F.expr(f"case when {on} then {text} end") for on, text in PART_LINES])
    rows = p.select(F.col("p_brand").alias("file"), "page", "block", "_r", F.posexplode(lines).alias("_p", "line")).filter("line is not null")
    return rows.select("file", "page", (F.col("_r") % PAGE_PARTS * 100 + F.col("_p")).cast("int").alias("line_no"), "line", "block")


_LINES = ", ".join(f"case when {on} then {text} end" for on, text in PART_LINES).replace("as string)", "as varchar)")
#: The same rows in DuckDB, numbered within each file.
PAGE_LINES_SQL = f"""
part0 as (select *, p_partkey as k, cast(floor(p_retailprice) as bigint) as d, row_number() over (partition by p_brand order by p_partkey) - 1 as r from part),
part1 as (select p_brand as file, r // {PAGE_PARTS} + 1 as page, r, unnest(range({len(PART_LINES)})) as p, unnest([{_LINES}]) as line from part0),
raw_lines as (select file, cast(page as integer) as page, cast(r % {PAGE_PARTS} * 100 + p as integer) as line_no, line from part1 where line is not null)
"""


def typed(p: DataFrame, name: str) -> DataFrame:
    """Parts with the place of their type among the brand's, from 1; brands and their types are few."""
    types = p.select("p_brand", "p_type").distinct()
    return with_digests(p, types.withColumn(name, F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type"))), ["p_brand", "p_type"])


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, page, line_no, line, block): a file per brand and a page per type, which list all headings, codes, names, sizes and prices of their parts one after the other."""
    parts = parts_of(spark, sf_dir, "part", len(STREAMS))
    p = numbered(typed(table(spark, sf_dir, "part"), "page"), ["p_brand", "p_type"], "p_partkey", "_r", parts).withColumn("k", F.col("p_partkey")).withColumn("r", (F.col("_r") + 1).cast("int"))
    p = dealt(p.withColumn("block", F.col("page")), parts, "p_brand", "block")
    lines = F.array(*[F.expr(f"case when {on} then {text} end") for on, text in STREAMS])
    rows = p.select(F.col("p_brand").alias("file"), "page", "block", "r", F.posexplode(lines).alias("s", "line")).filter("line is not null")
    return rows.select("file", "page", (F.col("s") * 1_000_000 + F.col("r")).alias("line_no"), "line", "block")


STREAMS = [
    ("r = 1 and k % 2 = 0", "concat(p_type, ' Collection')"),
    ("k % 3 <> 0", "'Chairs and more'"),
    ("k % 10 <> 9", "concat('pl-', cast(k as string))"),
    ("r = 2", "'Description/Name'"),
    ("true", "p_name"),
    ("r = 3", "'Brown Maple'"),
    ("k % 2 = 0", "concat(cast(p_size as string), '\" x 30')"),
    ("true", "concat('$', cast(p_size as string), '.50')"),
    ("r = 1", "'Ph: 555'"),
]

_STREAMS = ", ".join(f"case when {on} then {text} end" for on, text in STREAMS).replace("as string)", "as varchar)")
STREAM_LINES_SQL = f"""
part0 as (select *, p_partkey as k, row_number() over (partition by p_brand, p_type order by p_partkey) as r, dense_rank() over (partition by p_brand order by p_type) as page from part),
part1 as (select p_brand as file, cast(page as integer) as page, r, unnest(range({len(STREAMS)})) as s, unnest([{_STREAMS}]) as line from part0),
raw_lines as (select file, page, cast(s * 1000000 + r as integer) as line_no, line from part1 where line is not null)
"""
