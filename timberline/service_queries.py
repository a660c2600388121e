"""Further queries over the given tables: guesses about columns, upkeep, users, quotes and captions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import money, notes
from .operators import guesses, layouts, quotes, rollups, search, upkeep, writes
from .plans.catalog import parts_of, price_book, table
from .queries import FOUND, FOUND_SQL, ITEM, query

# sheets made of parts: one per brand, a row per part, seven columns


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("row", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    values = [F.col("p_name"), F.concat(F.lit("AB-"), F.col("p_partkey").cast("string")), F.concat(F.lit("$"), F.col("p_retailprice").cast("string")), F.col("p_type"), (F.col("p_retailprice") * 2.7).cast("string"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("call"), F.lit(" ")]
    cells = F.posexplode(F.array(*values)).alias("col", "value")
    return p.select(F.col("p_brand").alias("sheet"), "row", cells)


CELLS_SQL = """with p as (select *, row_number() over (partition by p_brand order by p_partkey) as place from part),
cells as (select p_brand as sheet, place - 1 as row, unnest(range(7)) as col, unnest([p_name, concat('AB-', p_partkey), concat('$', cast(p_retailprice as varchar)), p_type, cast(p_retailprice * 2.7::double as varchar),
  case when p_size > 25 then cast(p_size as varchar) else 'call' end, ' ']) as value from p),
v as (select *, try_cast(regexp_replace(value, '[$,\\s]', '', 'g') as double) as price from cells where trim(value) <> '')"""
PRICED_SQL = "(select sheet, col from v where row < 50 group by sheet, col having count(price) >= {n} and count(price) / count(*)::double >= 0.45)"


@query(f"{CELLS_SQL} select sheet, cast(col as integer) as col from {PRICED_SQL.format(n=3)}")
def price_columns(spark, sf_dir):
    return guesses.price_columns(_cells(spark, sf_dir))


@query(CELLS_SQL + r""" select sheet, cast(min(col) as integer) as col from (select sheet, col from v where row < 25 group by sheet, col
  having count(*) >= 3 and count(*) filter (regexp_matches(value, '(?i)^[A-Z0-9][A-Z0-9\-_/]{1,20}$') and not regexp_matches(value, '^\$?\s*[\d,]+(?:\.\d{1,2})?$')) >= 3) group by sheet""")
def code_columns(spark, sf_dir):
    return guesses.code_columns(_cells(spark, sf_dir))


@query(CELLS_SQL + rf""", n as (select sheet, col, count(*) filter (not regexp_matches(value, '^\$?\s*[\d,]+(?:\.\d{{1,2}})?$') and not regexp_matches(value, '^[\d.]+$') and length(value) >= 3
    and (contains(value, ' ') or length(value) >= 8 or regexp_matches(value, '^[A-Za-z].*[A-Za-z]$'))) as hits from v where row < 50 group by sheet, col having count(*) >= 5)
  select sheet, cast(col as integer) as col, hits from n where hits >= 5 and (sheet, col) not in (select (sheet, col) from {PRICED_SQL.format(n=6)})
  qualify row_number() over (partition by sheet order by hits desc, col) = 1""")
def name_columns(spark, sf_dir):
    return guesses.name_columns(_cells(spark, sf_dir))


# rows that trip the rules


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 9
    rows = price_book(spark, sf_dir)
    rows = rows.withColumn("part_number", F.when(k == 0, F.lit(None)).when(k == 1, "Item #").when(k == 2, "12 x 14").otherwise(F.col("part_number")))
    rows = rows.withColumn("base_price", F.when(k.isin(0, 3), F.lit(12.5)).when(k == 4, F.lit(None)).otherwise(F.col("base_price")))
    return rows.withColumn("description", F.when(k == 5, "Prices subject to change").when(k == 6, F.lit(None)).otherwise(F.col("description")))


MESSY_SQL = """, messy as (select * exclude (part_number, base_price, description), case id % 9 when 0 then null when 1 then 'Item #' when 2 then '12 x 14' else part_number end as part_number,
  case when id % 9 in (0, 3) then 12.5 when id % 9 = 4 then null else base_price end as base_price, case id % 9 when 5 then 'Prices subject to change' when 6 then null else description end as description from book)"""


@query(f"{MESSY_SQL} select vendor, part_number, base_price from messy where base_price is not null and (base_price >= 20 or coalesce(part_number, '') <> '') and coalesce(description, '') <> 'Prices subject to change' and coalesce(part_number, '') <> 'Item #'")
def cleaned_long_rows(spark, sf_dir):
    return layouts.long_rows(_messy(spark, sf_dir)).select("vendor", "part_number", "base_price")


@query(f"{MESSY_SQL} select vendor, coalesce(median(base_price) < 30 or avg(case when part_number = '12 x 14' then 1.0 else 0.0 end) > 0.3, true) as low from messy where id % 9 in (0, 2, 3) or vendor like '%7' group by vendor")
def low_quality(spark, sf_dir):
    rows = _messy(spark, sf_dir).filter((F.col("id") % 9).isin(0, 2, 3) | F.col("vendor").like("%7"))
    return upkeep.low_quality(rows, "vendor")


@query(f"{MESSY_SQL} select id, coalesce(part_number, case when description is not null then trim(substring(description, 1, 48)) end) as part_number from messy")
def filled_parts(spark, sf_dir):
    return upkeep.filled_parts(_messy(spark, sf_dir)).select("id", "part_number")


@query(""", r as (select id, split_part(part_number, '-', 1) as part_number, finish_state, base_price, case when id % 3 > 0 then species end as species, case when id % 2 = 0 then collection end as collection, description from book),
b as (select * from r qualify row_number() over (partition by part_number, finish_state, base_price, coalesce(species, '') order by collection is not null desc, length(description) desc, id) = 1)
select id from b qualify species is not null or max(species) over (partition by part_number, finish_state, base_price) is null""")
def best_matrix_rows(spark, sf_dir):
    rows = price_book(spark, sf_dir).withColumns({"part_number": F.substring_index("part_number", "-", 1), "species": F.when(F.col("id") % 3 > 0, F.col("species")), "collection": F.when(F.col("id") % 2 == 0, F.col("collection"))})
    used = rows.select("id", "part_number", "finish_state", "base_price", "species", "collection", "description")
    return upkeep.best_rows(used, parts_of(spark, sf_dir)).select("id")


@query(f"{MESSY_SQL} select part_number, finish_state, min(id) as id, arg_min(description, id) filter (description is not null) as description, arg_min(base_price, id) filter (base_price is not null) as base_price from messy group by part_number, finish_state")
def first_of_each(spark, sf_dir):
    return upkeep.first_of_each(_messy(spark, sf_dir).select("id", "part_number", "finish_state", "description", "base_price"), ["part_number", "finish_state"])


@query("select species, count(*) as n from (select case when id % 5 > 0 then species end as species from book) where species is null or species in ('Oak', 'Bright Colors') group by species")
def keep_species(spark, sf_dir):
    rows = price_book(spark, sf_dir).withColumn("species", F.when(F.col("id") % 5 > 0, F.col("species")))
    return rollups.rows_per(upkeep.keep_species(rows, ["Oak", "Bright Colors"]), "species").withColumnRenamed("n_rows", "n")


@query("select c_custkey from customer where c_custkey % 4 <> 1")
def not_ignored(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("slug", F.when(F.col("c_custkey") % 4 == 1, F.when(F.col("c_custkey") % 8 == 1, "Green-Meadows").otherwise("SIMPLE  living")).otherwise(F.col("c_name")))
    return upkeep.not_ignored(c, "slug", "c_name").select("c_custkey")


@query("select count(*) as n_groups from (select 1 from book group by vendor, split_part(part_number, '-', 1), species, finish_state, round(base_price, 2) having count(*) > 1)")
def exact_duplicate_groups(spark, sf_dir):
    rows = price_book(spark, sf_dir).withColumns({"part_number": F.substring_index("part_number", "-", 1), "description": F.lit(None).cast("string")})
    return upkeep.exact_duplicates(rows, parts_of(spark, sf_dir))


# writes


@query("select (select count(*) from book where id % 10 < 7 and vendor = 'Supplier#000000003') as deleted, (select count(*) from book where id % 10 >= 5 and vendor = 'Supplier#000000003') as inserted, (select count(*) from book where id % 10 >= 5 and vendor = 'Supplier#000000003') as total")
def replaced_counts(spark, sf_dir):
    book = price_book(spark, sf_dir)
    return writes.replaced_counts(book.filter("id % 10 < 7"), book.filter("id % 10 >= 5 and vendor = 'Supplier#000000003'"), "vendor", "Supplier#000000003")


@query("select vendor, count(*) as n_rows from book where vendor <> 'Supplier#000000003' group by vendor")
def replaced_by_nothing(spark, sf_dir):
    book = price_book(spark, sf_dir)
    return rollups.rows_per(writes.replace(book, book.limit(0), "vendor", "Supplier#000000003"), "vendor")


@query("select vendor, count(*) as n_rows from (select vendor from book where vendor <> 'FN Chair' union all select 'FN Chair' from book where id % 10 = 5) group by vendor")
def add_rows_to_builder(spark, sf_dir):
    book = price_book(spark, sf_dir)
    new = book.filter("id % 10 = 5").withColumn("vendor", F.lit("FN Chairs LLC"))
    return rollups.rows_per(writes.added(book, new, "replace_builder"), "vendor")


@query("select line_kind, count(*) as n_rows, max(base_price) as most from (select line_kind, base_price from book union all select 'addon', cast(99999 as double)) group by line_kind")
def added_charge(spark, sf_dir):
    book = price_book(spark, sf_dir)
    row = writes.addon("Supplier#000000003", " Glass top ", flat=99999.0)
    one = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'double' if c in ('base_price', 'addon_pct') else 'string'}" for c in row))
    return writes.append(book, one).groupBy("line_kind").agg(F.count(F.lit(1)).alias("n_rows"), F.max("base_price").alias("most"))


@query("select count(*) as total, count(distinct nullif(vendor, '')) as vendors, count(distinct nullif(collection, '')) as collections, count(distinct nullif(source_file, '')) as sources, (select count(*) from orders) as quotes from book")
def stats_with_quotes(spark, sf_dir):
    return rollups.stats_with_quotes(price_book(spark, sf_dir), table(spark, sf_dir, "orders"))


@query("select count(*) filter (o_orderstatus = 'F') as ok, count(*) filter (o_orderstatus = 'O') as errors, cast(sum(o_custkey) as bigint) as n_rows from orders")
def batch_totals(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error").otherwise("skipped").alias("status"), F.col("o_custkey").alias("total"))
    return upkeep.batch_totals(files)


# searches without words


@query("select id from book where false")
def empty_search_of_all(spark, sf_dir):
    return search.guarded(price_book(spark, sf_dir), "  ", vendor="All").select("id")


@query(f"select {FOUND_SQL} from book where {ITEM} and vendor = 'Supplier#000000003' order by vendor, collection, part_number, species_tier, description, id limit 8")
def search_sample(spark, sf_dir):
    return search.guarded(price_book(spark, sf_dir), "", 8, vendor="Supplier#000000003").select(*FOUND)


# users and integrations


@query("select c_custkey, case when lower(trim(label)) like '%admin%' then 'admin' when lower(trim(label)) like '%warehouse%' then 'floor' else 'sales' end as role from (select c_custkey, case c_custkey % 4 when 0 then ' Administrators' when 1 then 'WAREHOUSE staff' when 2 then null else c_mktsegment end as label from customer)")
def user_roles(spark, sf_dir):
    k = F.col("c_custkey") % 4
    label = F.when(k == 0, " Administrators").when(k == 1, "WAREHOUSE staff").when(k == 2, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", notes.role(label).alias("role"))


@query("select count(*) as n_users, count(*) filter (c_acctbal > 0) as n_active from customer")
def user_counts(spark, sf_dir):
    return rollups.active(table(spark, sf_dir, "customer").select((F.col("c_acctbal") > 0).alias("active")))


@query("""with u as (select c_custkey as user_id, case when c_custkey % 2 = 0 then concat('g', c_custkey) end as guid, upper(c_name) as name, concat('Dr. ', c_name) as display from customer),
i as (select c_custkey as k, concat('g', c_custkey) as guid, case when c_custkey % 3 = 0 then concat('dr. ', c_name) else c_name end as name from customer)
select k, coalesce((select min(user_id) from u where u.guid = i.guid), (select min(user_id) from u where lower(u.name) = lower(i.name) or lower(u.display) = lower(i.name))) as user_id from i""")
def matched_users(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    guid = F.concat(F.lit("g"), F.col("c_custkey").cast("string"))
    users = c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, guid).alias("guid"), F.upper("c_name").alias("name"), F.concat(F.lit("Dr. "), "c_name").alias("display"))
    new = c.select(F.col("c_custkey").alias("k"), guid.alias("guid"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("dr. "), "c_name")).otherwise(F.col("c_name")).alias("name"))
    return upkeep.matched_users(new, users).select("k", "user_id")


@query("""with o as (select s_name as name, true as ok, cast(1 as bigint) as at, cast(1 as bigint) as last_ok, 'old' as message from supplier where s_suppkey % 3 > 0),
n as (select s_name as name, s_suppkey % 2 = 0 as ok, cast(2 as bigint) as at, 'new' as message from supplier where s_suppkey % 5 > 0)
select coalesce(n.name, o.name) as name, coalesce(n.ok, o.ok) as ok, coalesce(n.at, o.at) as at, case when n.ok then n.at else o.last_ok end as last_ok, case when n.at is not null then n.message else o.message end as message from o full outer join n on o.name = n.name""")
def integration_status(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "name")
    old = s.filter("s_suppkey % 3 > 0").select("name", F.lit(True).alias("ok"), F.lit(1).cast("long").alias("at"), F.lit(1).cast("long").alias("last_ok"), F.lit("old").alias("message"))
    new = s.filter("s_suppkey % 5 > 0").select("name", (F.col("s_suppkey") % 2 == 0).alias("ok"), F.lit(2).cast("long").alias("at"), F.lit("new").alias("message"))
    return upkeep.merged_status(old, new)


@query("select c_custkey, sha256(c_name) as digest from customer")
def password_digests(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", notes.password_digest(F.col("c_name")).alias("digest"))


@query("select c_custkey, to_json({'role': c_mktsegment, 'nation': c_nationkey}) as meta_json from customer")
def meta_dump(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_mktsegment").alias("role"), F.col("c_nationkey").alias("nation"))).alias("meta_json"))


@query("select s_suppkey, coalesce(case when s_suppkey % 3 = 0 then 2.0::double end, case when s_suppkey % 3 = 1 then 1.9::double end, 2.7::double) as multiplier from supplier")
def effective_multiplier(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    return table(spark, sf_dir, "supplier").select("s_suppkey", upkeep.effective_multiplier(F.when(k == 0, F.lit(2.0)), F.when(k == 1, F.lit(1.9)).when(k == 2, F.lit(0.0)), F.lit(2.7)).alias("multiplier"))


# texts


@query("""with p as (select p_partkey, case p_partkey % 3 when 0 then '30x72' else cast(p_partkey as varchar) end as part, case p_partkey % 2 when 0 then p_name end as description, case p_partkey % 4 when 1 then 'Mult-Shaker' when 3 then '' end as collection from part)
select p_partkey, case when description is not null then description when part = '30x72' then concat(case when collection = 'Mult-Shaker' then 'Shaker' else 'Bookcase' end, ' ', part) when collection = 'Mult-Shaker' then concat('Shaker ', part) else part end as description from p""")
def described_parts(spark, sf_dir):
    k = F.col("p_partkey")
    part = F.when(k % 3 == 0, "30x72").otherwise(k.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", notes.described(part, F.when(k % 2 == 0, F.col("p_name")), F.when(k % 4 == 1, "Mult-Shaker").when(k % 4 == 3, "")).alias("description"))


@query("select p_partkey, case p_partkey % 3 when 0 then 'Aspen' when 1 then p_type else 'Casegoods' end as collection from part")
def sheet_collections(spark, sf_dir):
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, "Aspen  Collection ").when(k == 1, "Available in oak")
    return table(spark, sf_dir, "part").select("p_partkey", notes.sheet_collection(title, F.when(k == 1, F.col("p_type"))).alias("collection"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'rush · Stain: OCS-113' when o_orderkey % 3 = 1 then 'Stain: OCS-113' else 'rush' end as line_notes, case when o_orderkey % 3 = 2 then concat('call first', chr(10), 'Wood: Oak') else concat('call first', chr(10), 'Wood: Oak', chr(10), 'Stain: OCS-113') end as quote_notes from orders")
def stain_notes(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    line = F.when(k == 0, "rush · stain: Natural").when(k == 1, "Stain: Natural |").otherwise("rush | Stain: x")
    stain = F.when(k < 2, "OCS-113")
    quote = notes.headed(F.lit("call first\nWood: Elm\nstain: none"), F.lit("Oak"), stain, F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", notes.stained(line, stain).alias("line_notes"), quote.alias("quote_notes"))


@query("select id, concat('#', id, ' · ', substring(part_number, 1, 28), ' · $', format('{:,}', cast(adjusted_price as bigint)), ' · ', substring(description, 1, 36)) as caption from book")
def captions(spark, sf_dir):
    return price_book(spark, sf_dir).select("id", notes.caption(F.col("id"), F.col("part_number"), F.col("adjusted_price"), F.col("description")).alias("caption"))


@query("select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then '3' else '2.5' end as quantity from lineitem")
def quantity_texts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", notes.quantity_text(F.when(F.col("l_linenumber") % 2 == 0, F.lit(3.0)).otherwise(F.lit(2.5))).alias("quantity"))


@query("select o_orderkey, concat('Q-', strftime(o_orderdate, '%Y%m%d-%H%M%S')) as number from orders")
def quote_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", notes.quote_number(F.col("o_orderdate")).alias("number"))


@query("select c_nationkey, to_json(['b', 'a', c_name]) as favourites from customer where c_custkey <= 25")
def favourites_in_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey <= 25")
    return c.select("c_nationkey", F.to_json(upkeep.distinct_in_order(F.array(F.lit("b"), F.lit("a"), F.lit("b"), "c_name", "c_name"))).alias("favourites"))


# quotes


def _quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("quote_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").cast("string").alias("part_number"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("unit_price"), (F.col("l_discount") * 100.0).alias("discount_pct"), F.lit("").alias("notes"))


@query("select o_orderkey as quote_id, case when o_orderkey % 2 = 0 then 'sent' else o_orderstatus end as status, o_orderpriority as notes from orders")
def changed_quotes(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quote_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("notes"))
    return quotes.changed(q, q.filter("quote_id % 2 = 0").select("quote_id", F.lit("sent").alias("status"), F.lit(None).cast("string").alias("notes")), "quote_id", quotes.QUOTE_FIELDS)


@query("""select l_orderkey * 10 + l_linenumber as line_id, q as quantity, cast(round(cast(q * l_extendedprice * (1.0 - l_discount * 100.0::double / 100.0::double) as decimal(18,6)), 2) as double) as line_total
  from (select *, case when l_linenumber = 1 then 7.0::double else cast(l_quantity as double) end as q from lineitem)""")
def changed_quote_lines(spark, sf_dir):
    lines = _quote_lines(spark, sf_dir)
    return quotes.changed_lines(lines, lines.filter("line_no = 1").select("line_id", F.lit(7.0).alias("quantity")).distinct()).select("line_id", "quantity", "line_total")


@query("select l_orderkey * 10 + l_linenumber as line_id from lineitem where l_linenumber > 1")
def removed_quote_lines(spark, sf_dir):
    lines = _quote_lines(spark, sf_dir)
    return quotes.removed(lines, lines.filter("line_no = 1"), "line_id").select("line_id")


@query("select l_orderkey as quote_id, count(*) as n_lines from lineitem l where (l_orderkey, l_partkey, l_quantity) not in (select (l_orderkey, l_partkey, l_quantity) from lineitem where l_linenumber = 2) group by l_orderkey")
def quote_payloads(spark, sf_dir):
    lines = _quote_lines(spark, sf_dir)
    return quotes.payloads(quotes.new_lines(lines, lines.filter("line_no = 2"))).select("quote_id", "n_lines")


@query("select id, vendor as builder, part_number as part, description, species as wood, finish_state as finish, adjusted_price as retail from book where id % 2 = 0")
def retail_preview(spark, sf_dir):
    return quotes.retail_preview(price_book(spark, sf_dir).filter("id % 2 = 0"))


@query("select 'Aspen Works' as vendor, id, base_price, 2.2::double as multiplier from book where source_file = 'list-3.xlsx'")
def bound_session_rows(spark, sf_dir):
    parsed = quotes.wholesale_view(price_book(spark, sf_dir).filter("source_file = 'list-3.xlsx'"))
    return quotes.bound(parsed, "Aspen Works", 2.2).select("vendor", "id", "base_price", "multiplier")


@query("select l_orderkey, l_linenumber, concat('$', format('{:,}', cast(floor(l_extendedprice) as bigint)), '.50') as price from lineitem where l_linenumber = 1")
def money_texts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_linenumber", notes.money_text(F.floor("l_extendedprice") + 0.5).alias("price"))


@query("select l_linenumber, cast(count(*) as bigint) as n, cast(count(case when l_tax * 100.0::double > 0 then 1 end) as bigint) as n_taxed from lineitem group by l_linenumber")
def percent_fractions(spark, sf_dir):
    part = money.fraction(F.concat((F.col("l_tax") * 100.0).cast("string"), F.lit("%")))
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(part).alias("n"), F.count_if(part > 0).alias("n_taxed"))
