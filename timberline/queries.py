"""Queries over the given tables, one per operator, and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import labels, money, text
from .operators import cells as sheet
from .operators import duplicates, pages, pricing, rollups, search, upkeep, writes
from .plans.catalog import PRICE_BOOK_SQL, parts_of, price_book, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Thin catalogs have fewer rows than this here; the stand-in's vendors have several hundred each.
THIN = 480
FOUND = ["id", "vendor", "collection", "part_number", "description", "species", "option_key", "finish_state", "base_price", "adjusted_price"]
FOUND_SQL = ", ".join(FOUND)


def query(sql: str | None = None):
    """Registers a query, and its SQL over the stand-in catalog (`book`) and the given tables."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {PRICE_BOOK_SQL.strip()} {sql}" if "book" in sql else sql
        return f

    return register


def _find(name: str, text_: str, condition: str, rank: str | None, limit: int = search.LIMIT, **filters: str) -> None:
    """Registers a search; condition: SQL for what matches, with ~x~ for `a row holds x`."""
    fields = "concat_ws(chr(1), lower(vendor), lower(collection), lower(part_number), lower(description), lower(species), lower(source_file), lower(finish_state), coalesce(lower(option_key), ''), cast(base_price as varchar), cast(adjusted_price as varchar))"
    import re

    where = re.sub("~(.*?)~", lambda m: f"contains({fields}, '{m[1]}')", condition)
    browse = "vendor nulls first, collection nulls first, part_number nulls first, species_tier nulls first, description nulls first, id"
    order = browse if rank is None else f"""
      case when lower(trim(part_number)) = '{rank}' then 0 when starts_with(lower(trim(part_number)), '{rank}') then 1 when contains(lower(part_number), '{rank}') then 2
        when contains(lower(description), '{rank}') then 3 when contains(lower(collection), '{rank}') then 4 when contains(lower(species), '{rank}') then 5 else 6 end,
      case finish_state when 'finished' then 0 when 'unfinished' then 1 else 2 end,
      case when lower(part_number) like '%-dc' or lower(description) like '%dust cover%' then 1 else 0 end, length(part_number), {browse}"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(price_book(spark, sf_dir), text_, limit, **filters).select(*FOUND)

    run.__name__ = name
    query(f"select {FOUND_SQL} from book where {where} order by {order} limit {limit}")(run)


ITEM = "line_kind <> 'addon'"
_find("search_and", "red economy", f"{ITEM} and ~red~ and ~economy~", "economy")
_find("search_or_not", "(ring | widget) -small", f"{ITEM} and (~ring~ or ~widget~) and not ~small~", "widget")
_find("search_phrase", '"red widget" promo', f"{ITEM} and ~red widget~ and ~promo~", "red widget")
_find("search_negated_rank", "blue -economy", f"{ITEM} and ~blue~ and not ~economy~", "economy")
_find("search_operators_only", "AND OR NOT", "false", None)
_find("search_price", "1250", f"{ITEM} and ~1250~", "1250")
_find("search_sku", "brand#12", f"{ITEM} and ~brand#12~", "brand#12")
_find("filter_species_member", "", f"{ITEM} and species in ('Cherry', 'Cherry / Hard Maple / Hickory')", None, species="Cherry")
_find("filter_option", "", "(option_key = 'Cat. 1' or species = 'Cat. 1')", None, option="Cat. 1")
_find("filter_vendor_finish", "", f"{ITEM} and vendor = 'Supplier#000000003' and finish_state = 'finished'", None, vendor="Supplier#000000003", finish="Finished")
_find("browse_order", "", ITEM, None)


@query("select line_kind, count(*) as n_rows from book where line_kind <> 'addon' group by line_kind")
def hide_addons(spark, sf_dir):
    return search.filtered(price_book(spark, sf_dir)).groupBy("line_kind").agg(F.count(F.lit(1)).alias("n_rows"))


@query("select id, part_number from book where id in (select min(id) from book union all select max(id) from book union all select min(id) from book where line_kind = 'addon')")
def row_by_id(spark, sf_dir):
    book = price_book(spark, sf_dir)
    ends = book.agg(F.array(F.min("id"), F.max("id"), F.min(F.when(F.col("line_kind") == "addon", F.col("id")))).alias("ids"))
    return upkeep.by_ids(book, ends.select(F.explode("ids").alias("id"))).select("id", "part_number")


# money


@query("select l_orderkey, l_linenumber, l_extendedprice, case when l_extendedprice <= 0 then 0.0 else 2.0 * ceil(l_extendedprice / 2.0 - cast(1e-12 as double)) end as retail from lineitem")
def retail_even_dollar(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", money.even_dollar(F.col("l_extendedprice")).alias("retail"))


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved multipliers of every third vendor, and of a vendor that has no rows."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0")
    s = s.select(F.col("s_name").alias("name"), (1.5 + F.col("s_suppkey") % 4 * 0.5).alias("multiplier"), F.concat(F.lit("555-"), F.col("s_suppkey").cast("string")).alias("phone"))
    return s.unionByName(spark.createDataFrame([("Nobody", 2.0, "555")], s.schema))


SETTINGS_SQL = "settings as (select s_name as name, cast(1.5 as double) + s_suppkey % 4 * cast(0.5 as double) as multiplier, concat('555-', cast(s_suppkey as varchar)) as phone from supplier where s_suppkey % 3 = 0 union all select 'Nobody', 2.0, '555')"


@query(f", {SETTINGS_SQL} select id, coalesce(s.multiplier, b.multiplier) as multiplier, case when s.multiplier is null then adjusted_price else 2.0 * ceil(base_price * s.multiplier / 2.0 - cast(1e-12 as double)) end as adjusted_price from book b left join settings s on s.name = b.vendor and line_kind <> 'addon'")
def reapply_multiplier(spark, sf_dir):
    return pricing.reprice(price_book(spark, sf_dir), _settings(spark, sf_dir)).select("id", "multiplier", "adjusted_price")


@query("select id, adjusted_price from book")
def recompute_adjusted(spark, sf_dir):
    return pricing.recompute(price_book(spark, sf_dir).withColumn("adjusted_price", F.lit(0.0))).select("id", "adjusted_price")


@query("select count(*) as n_mismatched from book where p_partkey % 5 = 0 and adjusted_price <> 0")
def retail_mismatch_audit(spark, sf_dir):
    off = price_book(spark, sf_dir).withColumn("adjusted_price", F.when(F.floor(F.col("id") / 100000) % 5 == 0, F.lit(0.0)).otherwise(F.col("adjusted_price")))
    return rollups.mismatches(off)


@query("select s_suppkey, coalesce(case when s_suppkey % 2 = 0 and s_suppkey % 5 > 0 then cast(s_suppkey % 5 as double) end, case when s_suppkey % 3 > 0 then cast(s_suppkey % 3 as double) end, cast(2.7 as double)) as multiplier from supplier")
def resolve_multiplier(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", money.multiplier_of((k % 5).cast("double"), k % 2 == 0, (k % 3).cast("double"), F.lit(2.7)).alias("multiplier"))


@query("""select event_id, coalesce(try_cast(regexp_replace(props, '[$,\\s]', '', 'g') as double), try_cast(nullif(regexp_extract(props, '-?\\d+(?:\\.\\d+)?', 0), '') as double)) as amount from events""")
def money_from_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", money.loose_number(F.col("props")).alias("amount"))


# rollups


@query("select count(*) as total, count(distinct nullif(vendor, '')) as vendors, count(distinct nullif(collection, '')) as collections, count(distinct nullif(source_file, '')) as sources from book")
def stats(spark, sf_dir):
    return rollups.stats(price_book(spark, sf_dir))


@query(f", {SETTINGS_SQL} select vendor, count(*) as n_rows, count(distinct collection) as n_collections, count(distinct source_file) as n_sources, min(base_price) as min_base, max(base_price) as max_base, cast(sum(cast(b.multiplier as decimal(18,6))) as double) / count(b.multiplier) as avg_multiplier, max(s.multiplier) as saved_multiplier, max(phone) as phone from book b left join settings s on s.name = vendor where line_kind <> 'addon' group by vendor")
def vendor_summary(spark, sf_dir):
    return rollups.vendor_summary(price_book(spark, sf_dir), _settings(spark, sf_dir))


@query(f"select vendor, count(*) as n_rows from book where line_kind <> 'addon' group by vendor having count(*) < {THIN}")
def thin_catalogs(spark, sf_dir):
    return rollups.thin_catalogs(price_book(spark, sf_dir), THIN)


@query("select distinct vendor from book")
def distinct_vendors(spark, sf_dir):
    return rollups.distinct_values(price_book(spark, sf_dir), "vendor")


@query("select distinct collection from book where vendor = 'Supplier#000000003'")
def distinct_collections(spark, sf_dir):
    return rollups.distinct_values(price_book(spark, sf_dir), "collection", "Supplier#000000003")


@query("select distinct source_file from book")
def distinct_sources(spark, sf_dir):
    return rollups.distinct_values(price_book(spark, sf_dir), "source_file")


@query("select vendor, count(*) as n_rows from book group by vendor")
def rows_per_vendor(spark, sf_dir):
    return rollups.rows_per(price_book(spark, sf_dir), "vendor")


@query("select vendor, collection, cast(grouping(vendor) * 2 + grouping(collection) as integer) as level, count(*) as n_rows, min(base_price) as min_base, max(base_price) as max_base from book where line_kind <> 'addon' group by rollup(vendor, collection)")
def rollup_vendor_collection(spark, sf_dir):
    return rollups.rollup(price_book(spark, sf_dir))


@query("select vendor, part_number, min(case when species = 'Oak' then base_price end) as Oak, min(case when species = 'Oak / Brown Maple' then base_price end) as \"Oak / Brown Maple\" from book group by vendor, part_number")
def pivot_by_species(spark, sf_dir):
    return rollups.species_pivot(price_book(spark, sf_dir), ["Oak", "Oak / Brown Maple"], parts_of(spark, sf_dir))


@query("select distinct vendor, coalesce(option_key, case when line_kind = 'addon' then description end) as label from book where coalesce(option_key, case when line_kind = 'addon' then description end) is not null union select distinct vendor, 'Bright Colors' as label from book where species = 'Bright Colors' and line_kind <> 'addon'")
def option_facet(spark, sf_dir):
    return rollups.option_facet(price_book(spark, sf_dir))


@query("select distinct vendor, unnest(string_split(species, ' / ')) as label from book where species <> 'Bright Colors'")
def species_facet(spark, sf_dir):
    return rollups.species_facet(price_book(spark, sf_dir))


@query("select word, count(*) as n from (select unnest(string_split(lower(p_name), ' ')) as word from part) group by word")
def token_histogram(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("select max(length(vendor)) as vendor, max(length(part_number)) as part_number, max(length(description)) as description from book")
def column_widths(spark, sf_dir):
    return price_book(spark, sf_dir).agg(*[F.max(F.length(c)).cast("long").alias(c) for c in ("vendor", "part_number", "description")])


# duplicates


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with parts cut to their brand, so that configurations repeat."""
    return price_book(spark, sf_dir).withColumn("part_number", F.substring_index("part_number", "-", 1)).withColumn("option_key", F.lit(None).cast("string"))


DOUBLED_SQL = "doubled as (select id, vendor, collection, split_part(part_number, '-', 1) as part_number, species, finish_state, imported_at, base_price, description from book)"
GROUP_SQL = "lower(trim(vendor)), lower(trim(collection)), lower(trim(part_number)), lower(trim(species)), finish_state"


@query(f", {DOUBLED_SQL} select min(vendor) as vendor, min(collection) as collection, min(part_number) as part_number, min(species) as species, min(finish_state) as finish_state, cast(null as varchar) as option_key, cast(null as varchar) as dimensions, count(*) as dup_count from doubled group by {GROUP_SQL} having count(*) > 1 order by dup_count desc, vendor, collection, part_number, species, finish_state limit 100")
def dup_groups(spark, sf_dir):
    return duplicates.duplicate_groups(_doubled(spark, sf_dir), parts=parts_of(spark, sf_dir))


@query(f", {DOUBLED_SQL} select id from (select id, row_number() over (partition by {GROUP_SQL} order by imported_at desc, id desc) as n from doubled) where n = 1")
def cleanup_keep_newest(spark, sf_dir):
    return duplicates.newest_of_each(_doubled(spark, sf_dir), parts_of(spark, sf_dir)).select("id")


@query(f", {DOUBLED_SQL} select count(*) as n_groups, cast(sum(n - 1) as bigint) as n_surplus from (select count(*) as n from doubled group by {GROUP_SQL} having count(*) > 1)")
def cleanup_counts(spark, sf_dir):
    return duplicates.cleanup_report(_doubled(spark, sf_dir), parts_of(spark, sf_dir))


@query(f", {DOUBLED_SQL} select max(id) as id from doubled group by lower(vendor), lower(part_number), lower(species), finish_state, lower(description), round(base_price, 2)")
def exact_dup_keep_max_id(spark, sf_dir):
    keys = ["vendor", "part_number", "species", "finish_state", "description"]
    return duplicates.last_of_exact(_doubled(spark, sf_dir).select("id", *keys, "base_price"), keys, parts_of(spark, sf_dir)).select("id")


@query("select vendor, max(source_file) as source_file, count(*) as n_candidates from (select distinct collection as vendor, source_file from book) group by vendor")
def last_file_wins(spark, sf_dir):
    files = price_book(spark, sf_dir).select(F.col("collection").alias("vendor"), "source_file").distinct()
    return duplicates.best_per(files, "vendor", F.desc("source_file"))


@query("select c_nationkey, c_name, n_candidates from (select c_nationkey, c_name, count(*) over (partition by c_nationkey) as n_candidates, row_number() over (partition by c_nationkey order by case when c_mktsegment = 'MACHINERY' then 50 else 0 end desc, c_custkey desc, c_name) as n from customer) where n = 1")
def best_file_per_vendor(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("file", F.when(F.col("c_mktsegment") == "MACHINERY", "a wholesale.xlsx").otherwise("b.xlsx"))
    return duplicates.best_per(c, "c_nationkey", *duplicates.file_order(F.col("file"), F.col("c_custkey"))[:3], F.asc("c_name")).select("c_nationkey", "c_name", "n_candidates")


@query("select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events) where n <= 20")
def retention_newest(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("n", n).filter("n <= 20").select("event_type", "event_id")


# writes


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_book(spark, sf_dir).filter(F.col("id") % 10 < 7)


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_book(spark, sf_dir).filter(F.col("id") % 10 >= 5)
    return rows.withColumn("base_price", F.col("base_price") + 1.0).withColumn("description", F.when(F.col("id") % 2 == 0, F.col("description")))


@query("select id, vendor, base_price from book where id % 10 < 7 and vendor <> 'Supplier#000000003' union all select id, vendor, base_price + 1.0 from book where id % 10 >= 5 and vendor = 'Supplier#000000003'")
def replace_vendor(spark, sf_dir):
    new = _incoming(spark, sf_dir).filter(F.col("vendor") == "Supplier#000000003")
    return writes.replace(_base(spark, sf_dir), new, "vendor", "Supplier#000000003").select("id", "vendor", "base_price")


@query("select id, vendor, base_price from book where id % 10 < 7 and source_file <> 'list-3.xlsx' union all select id, vendor, base_price + 1.0 from book where id % 10 >= 5 and source_file = 'list-3.xlsx'")
def replace_source(spark, sf_dir):
    new = _incoming(spark, sf_dir).filter(F.col("source_file") == "list-3.xlsx")
    return writes.replace(_base(spark, sf_dir), new, "source_file", "list-3.xlsx").select("id", "vendor", "base_price")


@query("select vendor, count(*) as n_rows from book where vendor <> 'Supplier#000000003' group by vendor")
def delete_vendor(spark, sf_dir):
    return rollups.rows_per(writes.delete(price_book(spark, sf_dir), "vendor", "Supplier#000000003"), "vendor")


UPSERT_SQL = """, old as (select * from book where id % 10 < 7), new as (
  select * from (select id, vendor, collection, part_number, species, finish_state, option_key, base_price + 1.0 as base_price, case when id % 2 = 0 then description end as description,
    row_number() over (partition by lower(vendor), lower(collection), lower(part_number), lower(species), finish_state, lower(coalesce(option_key, '')) order by id) as n from book where id % 10 >= 5) where n = 1),
up as (select coalesce(o.id, n.id) as id, coalesce(n.base_price, o.base_price) as base_price, coalesce(n.description, o.description) as description,
  case when o.id is null then 'inserted' when n.id is not null then 'updated' else 'kept' end as change
  from old o full outer join new n on lower(o.vendor) = lower(n.vendor) and lower(o.collection) = lower(n.collection) and lower(o.part_number) = lower(n.part_number) and lower(o.species) = lower(n.species) and o.finish_state = n.finish_state and coalesce(o.option_key, '') = coalesce(n.option_key, ''))"""


@query(f"{UPSERT_SQL} select id, base_price, description, change from up")
def upsert_merge(spark, sf_dir):
    return writes.upsert(_base(spark, sf_dir), _incoming(spark, sf_dir)).select("id", "base_price", "description", "change")


@query(f"{UPSERT_SQL} select change, count(*) as n from up group by change")
def upsert_counts(spark, sf_dir):
    return writes.changes(writes.upsert(_base(spark, sf_dir), _incoming(spark, sf_dir)))


@query("select line_kind, count(*) as n_rows from (select line_kind from book where id % 10 < 7 union all select line_kind from book where id % 10 >= 5) group by line_kind")
def append_rows(spark, sf_dir):
    return rollups.rows_per(writes.append(_base(spark, sf_dir), _incoming(spark, sf_dir)), "line_kind")


@query(f", {SETTINGS_SQL} select name, multiplier from settings where name in (select vendor from book)")
def orphan_vendor_settings(spark, sf_dir):
    return pricing.orphans_removed(_settings(spark, sf_dir), price_book(spark, sf_dir)).select("name", "multiplier")


@query("with a as (select s_name as name, cast(s_suppkey as double) as multiplier, cast(null as varchar) as phone from supplier where s_suppkey % 2 = 0), b as (select s_name as name, cast(null as double) as multiplier, s_name as phone from supplier where s_suppkey % 3 = 0) select coalesce(b.name, a.name) as name, coalesce(b.multiplier, a.multiplier) as multiplier, coalesce(b.phone, a.phone) as phone from a full outer join b on a.name = b.name")
def vendor_settings_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    old = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("double").alias("multiplier"), F.lit(None).cast("string").alias("phone"))
    new = s.filter("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"), F.lit(None).cast("double").alias("multiplier"), F.col("s_name").alias("phone"))
    return pricing.merged_settings(old, new)


# quotes


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("quote_id", F.col("l_orderkey")).withColumn("line_total", money.line_total(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount") * 100.0))


LINE_SQL = "cast(round(cast(l_quantity * l_extendedprice * (1.0 - l_discount * cast(100.0 as double) / cast(100.0 as double)) as decimal(18,6)), 2) as double)"


@query(f"select l_orderkey, l_linenumber, l_quantity, {LINE_SQL} as line_total from lineitem")
def quote_line_total(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "line_total")


@query(f"""with t as (select l_orderkey as quote_id, cast(sum(cast({LINE_SQL} as decimal(18,2))) as double) as s, count(*) as n from lineitem group by l_orderkey),
q as (select o_orderkey as quote_id, coalesce(s, 0.0) as subtotal, cast(o_custkey % 11 as double) as d, cast(o_custkey % 9 as double) as x, coalesce(n, 0) as line_count from orders left join t on t.quote_id = o_orderkey),
a as (select *, cast(round(cast(subtotal * (1.0 - d / cast(100.0 as double)) as decimal(18,6)), 2) as double) as kept from q),
b as (select *, cast(round(cast(kept * (x / cast(100.0 as double)) as decimal(18,6)), 2) as double) as tax_amount from a)
select quote_id, subtotal, cast(round(cast(subtotal - kept as decimal(18,6)), 2) as double) as discount_amount, tax_amount, cast(round(cast(kept + tax_amount as decimal(18,6)), 2) as double) as grand_total, line_count from b""")
def quote_totals(spark, sf_dir):
    quotes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quote_id"), (F.col("o_custkey") % 11).cast("double").alias("discount_pct"), (F.col("o_custkey") % 9).cast("double").alias("tax_pct"))
    return pricing.totals(_lines(spark, sf_dir), quotes)


@query("select o_orderkey, o_orderdate, coalesce(n, 0) as line_count from orders left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) on l_orderkey = o_orderkey order by o_orderdate desc, o_orderkey limit 100")
def quote_list_with_counts(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders")
    out = o.join(n, o["o_orderkey"] == n["l_orderkey"], "left").select("o_orderkey", "o_orderdate", F.coalesce("n", F.lit(0)).alias("line_count"))
    return out.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@query("select o_orderkey as quote_id, cast(coalesce(max(l_linenumber), 0) + 1 as integer) as line_no from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def next_line_no(spark, sf_dir):
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quote_id"))
    last = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("quote_id"), F.col("l_linenumber").alias("line_no"))
    return pricing.numbered(new, last, F.col("quote_id")).select("quote_id", "line_no")


@query("select l_orderkey as quote_id, l_linenumber, b.id, b.vendor, adjusted_price as unit_retail, cast(round(cast(l_quantity * adjusted_price * (1.0 - cast(0.0 as double) / cast(100.0 as double)) as decimal(18,6)), 2) as double) as line_total from lineitem join book b on b.id = l_partkey * 100000 + l_suppkey")
def quote_lines_from_catalog(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("quote_id"), "l_linenumber", (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id"), F.col("l_quantity").alias("qty"), F.lit(None).cast("double").alias("unit_retail"), F.lit(0.0).alias("line_discount_pct"))
    return pricing.quote_lines(wanted, price_book(spark, sf_dir)).select("quote_id", "l_linenumber", "id", "vendor", "unit_retail", "line_total")


# reshaping


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 5 > 0, p).alias("Oak"), (p + 50).alias("Cherry"), F.when(F.col("p_size") % 3 > 0, p + 100).alias("Walnut"))


@query("select p_partkey, p_name, 'Oak' as species, p_retailprice as base_price from part where p_size % 5 > 0 union all select p_partkey, p_name, 'Cherry', p_retailprice + 50 from part union all select p_partkey, p_name, 'Walnut', p_retailprice + 100 from part where p_size % 3 > 0")
def unpivot_wide_species(spark, sf_dir):
    return sheet.unpivoted(_matrix(spark, sf_dir), ["p_partkey", "p_name"], ["Oak", "Cherry", "Walnut"], "species", "base_price")


@query("select p_partkey, 'unfinished' as finish_state, p_retailprice as base_price from part union all select p_partkey, 'finished', cast(round(cast(p_retailprice * cast(1.2 as double) as decimal(18,6)), 2) as double) from part")
def unpivot_finish(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("unfinished"), money.cents(F.col("p_retailprice") * 1.2).alias("finished"))
    return sheet.unpivoted(rows, ["p_partkey"], ["unfinished", "finished"], "finish_state", "base_price")


@query("select p_partkey, w.species, cast(round(cast(p_retailprice * (1.0 + w.pct) as decimal(18,6)), 2) as double) as base_price from part, (values ('Brown Maple', cast(0.0 as double)), ('Cherry', cast(0.1 as double)), ('Walnut', cast(0.6 as double))) w(species, pct)")
def percent_expand_woods(spark, sf_dir):
    woods = spark.createDataFrame([("Brown Maple", 0.0), ("Cherry", 0.1), ("Walnut", 0.6)], "species string, pct double")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("base_price"), F.lit("x").alias("species"))
    return sheet.percent_expanded(rows, woods)


@query("select event_type, event_id, last_value(case when value > 100 then event_id end ignore nulls) over (partition by event_type order by event_id rows unbounded preceding) as section from events")
def collection_carry_down(spark, sf_dir):
    return sheet.carried(table(spark, sf_dir, "events"), F.when(F.col("value") > 100, F.col("event_id")), ["event_type"], "event_id", "section").select("event_type", "event_id", "section")


@query("select conv_id, turn, case when lead(turn) over (partition by conv_id order by turn) = turn + 1 then lead(role) over (partition by conv_id order by turn) end as next_role from conversations")
def price_next_row(spark, sf_dir):
    return sheet.next_row(table(spark, sf_dir, "conversations"), "role", ["conv_id"], "turn", "next_role").select("conv_id", "turn", "next_role")


@query("with r as (select conv_id, role, text, row_number() over (partition by conv_id, role order by turn) as k from conversations where role in ('user', 'assistant')) select conv_id, cast(k as integer) as k, max(case when role = 'user' then text end) as \"user\", max(case when role = 'assistant' then text end) as assistant from r group by conv_id, k")
def columnar_zip(spark, sf_dir):
    return sheet.zipped(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text", ["user", "assistant"])


@query("select p_type, p_partkey, case when n > 1 then concat(p_name, ' (', cast(n as varchar), ')') else p_name end as name from (select p_type, p_partkey, p_name, row_number() over (partition by p_type, p_name order by p_partkey) as n from part)")
def numbered_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.col("p_type").alias("sheet"), F.col("p_partkey").alias("col"), F.col("p_name").alias("name"))
    return sheet.numbered_names(rows).select(F.col("sheet").alias("p_type"), F.col("col").alias("p_partkey"), "name")


# labels


@query("""select doc_id, case when s = '' or lower(s) in ('nan', 'none', 'null') then null else s end as clean from (select doc_id, trim(regexp_replace(translate(text, chr(8220) || chr(8221) || chr(8216) || chr(8217) || chr(8211) || chr(8212) || chr(160), '""''''-- '), '\\s+', ' ', 'g')) as s from documents)""")
def standardize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query(r"select p_partkey, code, regexp_matches(code, '(?i)^([A-Z]{1,4}-[A-Z0-9][A-Z0-9\-_/.]{1,24}|[A-Z]{2,6}\d{2,}[A-Z0-9\-]*|\d{3,6})$') as is_code from (select p_partkey, case p_partkey % 4 when 0 then concat('LA-', cast(p_partkey as varchar)) when 1 then p_name when 2 then cast(p_partkey as varchar) else concat('HW', cast(p_partkey as varchar)) end as code from part)")
def sku_like(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.when(k % 4 == 0, F.concat(F.lit("LA-"), k.cast("string"))).when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, k.cast("string")).otherwise(F.concat(F.lit("HW"), k.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).withColumn("is_code", text.is_item_code(F.col("code")))


@query("select id, unnest(string_split(species, ' / ')) as wood from book where species <> 'Bright Colors'")
def species_tokens(spark, sf_dir):
    rows = price_book(spark, sf_dir).filter(~labels.is_option(F.col("species")))
    distinct = rows.select("species").distinct().select(F.col("species").alias("s"), text.woods(F.col("species")).alias("woods"))
    return rows.join(distinct, rows["species"] == distinct["s"]).select("id", F.explode("woods").alias("wood"))


@query("select file, pages, chars, money, chars < 80 * pages and money < 5 as scanned from (select lang as file, count(distinct source) as pages, cast(sum(length(text)) as bigint) as chars, cast(sum(len(regexp_extract_all(text, '\\$\\s*(\\d{1,3}(?:,\\d{3})*(?:\\.\\d{2})?|\\d+(?:\\.\\d{2})?)'))) as bigint) as money from documents group by lang)")
def pdf_text_stats(spark, sf_dir):
    return pages.statistics(table(spark, sf_dir, "documents").select(F.col("lang").alias("file"), F.col("source").alias("page"), F.col("text").alias("line")))


@query("select distinct page_id, replace(unnest(regexp_extract_all(html, '(?i)<a[^>]+href=[\"'']([^\"'']+)[\"'']', 1)), '&amp;', '&') as href from pages")
def price_tab_links(spark, sf_dir):
    return pages.price_links(table(spark, sf_dir, "pages"))


def _department_sql(x: str) -> str:
    return "case " + " ".join(f"when {' or '.join(f'contains({x}, {chr(39)}{w}{chr(39)})' for w in words)} then '{name}'" for name, words in text.DEPARTMENTS) + " else 'OTHER' end"


@query(f"select doc_id, {_department_sql('lower(text)')} as department from documents")
def map_category(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.department(F.lit(None).cast("string"), F.col("text")).alias("department"))


@query("select s_suppkey, case s_suppkey % 4 when 0 then 'Hope Wood' when 1 then 'Millers Woodshop' when 2 then s_name else 'J & M Woodworking' end as vendor from supplier")
def resolve_vendor(spark, sf_dir):
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, "HopeWood Price List 2026").when(k % 4 == 1, "MWS 2023 Wholesale Price List").when(k % 4 == 2, F.concat("s_name", F.lit(" Pricelist 2025.xlsx"))).otherwise("j and m woodworking")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw"))
    distinct = rows.select("raw").distinct().select(F.col("raw").alias("r"), text.vendor(F.col("raw")).alias("vendor"))
    return rows.join(distinct, rows["raw"] == distinct["r"]).select("s_suppkey", "vendor")


@query("select c_custkey, case when c_custkey % 2 = 0 then concat('user.', cast(c_custkey as varchar)) else concat(lower(c_mktsegment), '.', regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g')) end as username from customer")
def slug_username(spark, sf_dir):
    k = F.col("c_custkey")
    email = F.when(k % 2 == 0, F.concat(F.lit("User."), k.cast("string"), F.lit("@example.com"))).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", text.user_name(F.concat("c_name", F.lit(", "), "c_mktsegment"), email).alias("username"))


@query("select s_suppkey, trim(regexp_replace(replace(lower(concat(s_name, ' & Co.')), '&', 'and'), '[^a-z0-9]+', ' ', 'g')) as key from supplier")
def norm_builder_key(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.builder_key(F.concat("s_name", F.lit(" & Co."))).alias("key"))


@query("select p_partkey, case when p_size % 4 = 0 then 'unfinished' when p_size % 4 = 1 then 'glazed' when p_size % 4 = 2 then 'finished' end as finish_state from part")
def standardize_finish(spark, sf_dir):
    k = F.col("p_size") % 4
    raw = F.when(k == 0, " UNF. ").when(k == 1, "Glazed tops").when(k == 2, "Finshed").otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", text.finish(raw).alias("finish_state"))


@query("select p_type, case when p_type = upper(p_type) and length(p_type) between 4 and 39 then concat(upper(p_type[1]), lower(p_type[2:])) else p_type end as collection from (select distinct p_type from part)")
def standardize_collection(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type").distinct().select("p_type", text.collection(F.col("p_type"), F.lit(None).cast("string")).alias("collection"))


@query("select id, vendor, concat(upper(collection[1]), lower(collection[2:])) as collection, part_number, species, finish_state, base_price, adjusted_price, multiplier from book where base_price > 0")
def standardize_rows(spark, sf_dir):
    return writes.standardized(price_book(spark, sf_dir)).select("id", "vendor", "collection", "part_number", "species", "finish_state", "base_price", "adjusted_price", "multiplier")


# sessions and integrations


@query("select user_id, max(ts) as saved_at, date_diff('second', max(ts), timestamp '2024-02-01 00:00:00') <= 86400 * 20 as fresh from events group by user_id")
def session_ttl_fresh(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("saved_at"))
    return by.withColumn("fresh", F.timestamp_diff("SECOND", "saved_at", now) <= 86400 * 20) if hasattr(F, "timestamp_diff") else by.withColumn("fresh", F.unix_seconds(now) - F.unix_seconds("saved_at") <= 86400 * 20)


@query("select p_partkey, substring(sha256(concat(p_name, '|', cast(p_size as varchar))), 1, 32) as key from part")
def batch_key_sha256(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha2(F.concat_ws("|", "p_name", F.col("p_size").cast("string")), 256), 1, 32).alias("key"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def integration_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("select vendor, count(*) as n_rows, cast(sum(cast(concat('0x', substring(sha256(concat(cast(id as varchar), ':', part_number)), 1, 14)) as bigint)) as varchar) as fingerprint from book group by vendor")
def catalog_fingerprint(spark, sf_dir):
    return rollups.fingerprints(price_book(spark, sf_dir), "vendor")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def windowed_counts(spark, sf_dir):
    from .streaming.ingest import windowed_counts as counts

    return counts(table(spark, sf_dir, "events"))


from . import change_queries, page_queries, service_queries, session_queries, sheet_queries, user_queries  # noqa: E402, F401  (register more)
