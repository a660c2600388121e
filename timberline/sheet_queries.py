"""Queries over sheets made of the parts, with their SQL: headers of two rows, columns that belong together, copies among sheets, flyers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cells as grid
from .operators import guesses, sheets
from .operators.running import dealt, numbered
from .plans.catalog import parts_of, table
from .queries import query


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their place in the brand, from 0."""
    return numbered(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "r", parts_of(spark, sf_dir, "part")).withColumn("r", F.col("r").cast("int"))


NUMBERED_SQL = "n0 as (select *, row_number() over (partition by p_brand order by p_partkey) as place from part), n as (select * exclude (place), cast(place - 1 as integer) as r from n0)"


def _spread(rows: DataFrame, texts: list[str], *keep: str) -> DataFrame:
    """One cell a text: (*keep, col, text); texts: SQL that Spark and DuckDB share."""
    return rows.select(*keep, F.posexplode(F.array(*[F.expr(f"cast({t} as string)") for t in texts])).alias("col", "text")).filter("text is not null")


def _spread_sql(source: str, texts: list[str], *keep: str) -> str:
    cells = ", ".join(f"cast({t} as varchar)".replace(" as string)", " as varchar)") for t in texts)
    return f"(select * from (select {', '.join(keep)}, cast(unnest(range({len(texts)})) as integer) as col, unnest([{cells}]) as text from {source}) where text is not null)"


# names of columns of flat sheets: a row of three headers per part

WORDS = ["Item  #", "DESC", "Wood", "Net", "Price", "SKU", "Style", "model", "Amount", "Colour", "Remarks", "U.M."]
_HEADER = f"element_at(array({', '.join(map(_sql, WORDS))}), cast({{x}} % {len(WORDS)} as int) + 1)"
_HEADER_SQL = f"([{', '.join(map(_sql, WORDS))}])[{{x}} % {len(WORDS)} + 1]"
HEADER_SIZES = ["p_size", "p_size + 5", "p_partkey"]


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_numbered(spark, sf_dir), [_HEADER.format(x=f"({x})") for x in HEADER_SIZES], "p_brand", "r").select(F.col("p_brand").alias("sheet"), F.col("r").alias("row"), F.col("text").alias("header"))


ALIASES_SQL = "(values " + ", ".join(f"('{f}', {k}, {_sql(a)})" for f, names in guesses.ALIASES.items() for k, a in enumerate(names)) + ") a(field, place, name)"
HEADERS_SQL = f"{NUMBERED_SQL}, h as (select p_brand as sheet, r as row, text as header, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as name from {_spread_sql('n', [_HEADER_SQL.format(x=f'({x})') for x in HEADER_SIZES], 'p_brand', 'r')})"


@query(f"with {HEADERS_SQL} select sheet, field, arg_min(header, place) as header from h join {ALIASES_SQL} using (name) group by sheet, field")
def mapped_columns(spark, sf_dir):
    return guesses.mapped_columns(_headers(spark, sf_dir).select("sheet", "header"))


@query(f"""with {HEADERS_SQL}, f as (select name, min_by(field, o) as field from (select *, row_number() over () as o from {ALIASES_SQL}) group by name),
c as (select sheet, row from h join f using (name) where row < 8 group by sheet, row having count(distinct field) >= 2) select sheet, min(row) as row from c group by sheet""")
def first_usable_row(spark, sf_dir):
    return guesses.first_usable(_headers(spark, sf_dir))


# marked-up sheets: woods in columns 4, 5, 6 and 8, wholesale prices beside them

MARKED = ["p_name", "concat('AB-', cast(p_partkey as string))", "p_retailprice", "p_retailprice * cast(1.02 as double)", "p_retailprice * cast(2.7 as double)", "p_retailprice * cast(2.7 as double)", "p_retailprice * cast(5 as double)",
          "case when p_size % 3 = 0 then 'call' else cast(p_retailprice * cast(1.05 as double) as string) end", "p_retailprice * cast(1.02 as double) * cast(2.7 as double)"]
MARKED_WOODS = [4, 5, 6, 8]
MARKED_SQL = f"""{NUMBERED_SQL}, v as (select p_brand as sheet, r as row, col, text as value, try_cast(text as double) as price from {_spread_sql('n', MARKED, 'p_brand', 'r')} where r < 50),
p as (select sheet, col from v group by sheet, col having count(price) >= 2 and count(price) / count(*)::double >= 0.45),
pairs as (select a.sheet, a.col, b.col as wholesale, list_sort(list(a.price / b.price)) as ratios from v a join v b on a.sheet = b.sheet and a.row = b.row
  where a.row < 40 and a.col in (4, 5, 6, 8) and b.col not in (4, 5, 6, 8) and a.price is not null and b.price is not null and (b.sheet, b.col) in (select (sheet, col) from p) group by all),
able as (select *, abs(ratios[len(ratios) // 2 + 1] - 2.7::double) / 2.7::double as error from pairs where len(ratios) >= 3),
near as (select sheet, col, wholesale, error, dense_rank() over (partition by sheet order by col) as k from able where error < 0.08)"""
#: Woods take their columns one after the other.
TAKEN_SQL = """taken as (
  select sheet, 0::bigint as k, []::integer[] as used, null::integer as col, null::integer as wholesale from (select distinct sheet from near)
  union all
  select sheet, k, case when w is null then used else list_append(used, w) end, col, w from (
    select t.sheet, t.k + 1 as k, t.used, x.col, (select arg_min(n.wholesale, (n.error, n.wholesale)) from near n where n.sheet = t.sheet and n.k = t.k + 1 and not list_contains(t.used, n.wholesale)) as w
    from taken t join (select distinct sheet, k, col from near) x on x.sheet = t.sheet and x.k = t.k + 1))"""


@query(f"with recursive {MARKED_SQL}, {TAKEN_SQL} select sheet, col, wholesale from taken where wholesale is not null")
def wholesale_columns(spark, sf_dir):
    cells = _spread(_numbered(spark, sf_dir), MARKED, "p_brand", "r").select(F.col("p_brand").alias("sheet"), F.col("r").alias("row"), "col", F.col("text").alias("value"))
    return guesses.wholesale_columns(cells, cells.filter(F.col("col").isin(MARKED_WOODS)).select("sheet", "col").distinct(), 2.7)


# headers of two rows: every fourteen parts of a brand are the columns of a sheet

TOPS = ["'Oak'", "'Oak'", "'Brown Maple'", "null", "null", "null", "'Cherry'", "'Hick'", "'Width'", "'Total'", "'Finished  each'", "null"]
BOTTOMS = ["'Finished'", "'Unfinished'", "'Finished'", "'unf.'", "'Glazed'", "'each'", "null"]
_TOP = "case when j = 0 then 'Item #' when j = 1 then 'Description' when j > 8 and p_size = 7 then 'Mark up over' else " + "case p_size % 12 " + " ".join(f"when {k} then {t}" for k, t in enumerate(TOPS)) + " end end"
_BOTTOM = "case when j > 1 then case p_partkey % 7 " + " ".join(f"when {k} then {t}" for k, t in enumerate(BOTTOMS)) + " end end"
TWO_ROWS = [_TOP, _BOTTOM, "case when j = 5 and p_size % 2 = 0 then null else 100 + j end"]
_FIN = f"coalesce(regexp_matches(lower({{x}}), {_sql(grid.FINISH_HEADER)}) and not regexp_matches(lower({{x}}), {_sql(sheets.NO_FINISH)}), false)"
TWO_ROWS_SQL = f"""{NUMBERED_SQL}, w as (select *, r % 14 as c, r // 14 as s from n), u as (select *, c as j from w),
cells0 as (select p_brand as file, cast(s as varchar) as sheet, cast(unnest([0, 1, 3]) as integer) as row, c as col, unnest([{', '.join(f'cast({t} as varchar)' for t in TWO_ROWS)}]) as text from u),
cells as (select file, sheet, row, col, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from cells0 where text is not null),
g0 as (select file, sheet, col, max(text) filter (row = 0) as top, row_number() over (partition by file, sheet order by col) - 1 as j from cells where (file, sheet) in (select (file, sheet) from cells where row = 0) group by file, sheet, col),
nx as (select file, sheet, min(row) as next from cells where row > 0 group by file, sheet),
g as (select g0.*, next, text as bottom from g0 left join nx using (file, sheet) left join cells b on b.file = g0.file and b.sheet = g0.sheet and b.col = g0.col and b.row = next),
f as (select *, {_FIN.format(x='bottom')} as fin, count(*) filter ({_FIN.format(x='bottom')}) over (partition by file, sheet) >= 2 as two,
  bool_or(coalesce(regexp_matches(top, {_sql(sheets.MARKUP_HEADER)}), false) or coalesce(regexp_matches(bottom, {_sql(sheets.MARKUP_HEADER)}), false)) over (partition by file, sheet order by j rows unbounded preceding) as past,
  top is not null and not {_FIN.format(x='top')} and not starts_with(lower(top), 'col_') and not (regexp_matches(lower(top), {_sql(grid.ID_HEADER)}) and length(top) < 40) and not regexp_matches(lower(top), {_sql(grid.DESC_HEADER)}) and not regexp_matches(lower(top), {_sql(grid.DIM_HEADER)}) as says,
  regexp_matches(lower(top), {_sql(grid.WOOD_HEADER)}) or regexp_matches(top, {_sql(sheets.SHORT_WOODS)}) as woody from g),
c as (select *, last_value(case when says then case when woody then top else '' end end ignore nulls) over (partition by file, sheet order by j rows unbounded preceding) as wood from f),
nm as (select *, case when two then case when past then concat('skip_', j) when fin and coalesce(wood, '') <> '' then concat(wood, ' | ', bottom) else coalesce(top, bottom, concat('col_', j)) end else coalesce(top, concat('col_', j)) end as name0 from c),
gr as (select *, case when two and contains(name0, ' | ') then string_split(name0, ' | ')[1] end as grp, lower(string_split(name0, ' | ')[2]) as side from nm),
q0 as (select file, sheet, grp, min(j) as first, bool_or(contains(side, 'unf')) as u, bool_or(contains(side, 'fin') and not contains(side, 'unf')) as fi from gr where grp is not null group by file, sheet, grp),
q1 as (select *, case when bool_or(u) over (partition by file, sheet) then fi and u else fi or u end as whole from q0),
q as (select file, sheet, grp, bool_and(whole) over (partition by file, sheet order by first rows unbounded preceding) as complete from q1),
h as (select gr.file, gr.sheet, gr.col, case when gr.grp is not null and not starts_with(name0, 'skip_') and not complete then concat('skip_', name0) else name0 end as base, case when two then next else 0 end as body from gr left join q on q.file = gr.file and q.sheet = gr.sheet and q.grp = gr.grp),
named as (select file, sheet, col, case when row_number() over (partition by file, sheet, base order by col) > 1 then concat(base, ' (', row_number() over (partition by file, sheet, base order by col), ')') else base end as name, body from h)"""


def _two_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _numbered(spark, sf_dir).withColumn("j", F.col("r") % 14).withColumn("sheet", F.floor(F.col("r") / 14).cast("string"))
    cells = _spread(dealt(p.withColumnRenamed("p_brand", "file"), parts_of(spark, sf_dir, "part", len(TWO_ROWS)), "file", "sheet"), TWO_ROWS, "file", "sheet", "j")
    return cells.select("file", "sheet", F.element_at(F.array(*map(F.lit, (0, 1, 3))), F.col("col") + 1).alias("row"), F.col("j").alias("col"), "text")


def _top_rows(cells: DataFrame) -> DataFrame:
    return cells.filter("row = 0").select("file", "sheet", F.col("row").alias("header")).distinct()


@query(f"with {TWO_ROWS_SQL} select file, sheet, col, name from named")
def two_row_headers(spark, sf_dir):
    cells = _two_rows(spark, sf_dir)
    return sheets.headed(cells, _top_rows(cells))[0]


@query(f"with {TWO_ROWS_SQL} select distinct file, sheet, cast(0 as integer) as header, body from named")
def header_places(spark, sf_dir):
    cells = _two_rows(spark, sf_dir)
    return sheets.headed(cells, _top_rows(cells))[1]


# copies among the sheets of a file: a file per brand, a sheet per size of its parts

SHEET_NAMES = ["'Chairs'", "'Retail 2026'", "'Wholesale 2026'", "'Price List'", "'Price List with Markup'", "'Mark Up'", "'Beds Mark-up'", "concat('Sheet ', cast(p_size as string))"]
_SHEET = "case when p_size % 10 < 7 and cast(substring(p_brand, 7) as int) % 3 <> p_size % 3 then case p_size % 10 " + " ".join(f"when {k} then {t}" for k, t in enumerate(SHEET_NAMES[:7])) + f" end else {SHEET_NAMES[7]} end"
COPIES_SQL = f"s as (select *, {_SHEET.replace(' as string)', ' as varchar)')} as sheet from part)"
_MARKED = f"regexp_matches(sheet, {_sql(sheets.MARKED_UP_SHEET)}) and not regexp_matches(sheet, {_sql(sheets.CONTROL_SHEET)})"
COUNTED_SQL = f"""ok as (select distinct p_brand, sheet from s where not (regexp_matches(sheet, {_sql(sheets.RETAIL_SHEET)}) and p_brand in (select p_brand from s where regexp_matches(sheet, {_sql(sheets.WHOLESALE_SHEET)})))
  and not ({_MARKED} and p_brand in (select p_brand from s where regexp_matches(sheet, {_sql(sheets.PLAIN_SHEET)}) and not regexp_matches(sheet, {_sql(sheets.ANY_MARKUP)}))))"""


@query(f"with {COPIES_SQL}, {COUNTED_SQL} select p_brand as file, sheet, cast(p_partkey as integer) as row, cast(col as integer) as col, text from (select s.*, unnest([0, 1]) as col, unnest([p_name, cast(p_size as varchar)]) as text from s) join ok using (p_brand, sheet)")
def without_copies(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("sheet", F.expr(_SHEET)).withColumn("row", F.col("p_partkey").cast("int"))
    return sheets.without_copies(_spread(p, ["p_name", "p_size"], "p_brand", "sheet", "row").select(F.col("p_brand").alias("file"), "sheet", "row", "col", "text"))


TWINS = ["p_retailprice", "p_retailprice * cast(2.5 as double) + case when p_size = 3 then cast(400 as double) else cast(0 as double) end", "p_size", "case when p_size % 2 = 0 then 40 + p_size else 90 end"]


@query(f"""with {NUMBERED_SQL}, v as (select p_brand as file, r as row, col as sheet, cast(text as double) as price from {_spread_sql('n', TWINS, 'p_brand', 'r')}),
x as (select a.file, a.sheet, b.sheet as twin, a.price / b.price as ratio from v a join v b on a.file = b.file and a.row = b.row and a.sheet <> b.sheet where abs(a.price / b.price - 1) > 1e-9),
m as (select file, sheet, twin, quantile_disc(ratio, 0.5) as m from x group by file, sheet, twin)
select file, cast(sheet as varchar) as sheet, cast(twin as varchar) as twin, max(m) as ratio, count(*) as n from x join m using (file, sheet, twin) group by file, sheet, twin
having max(m) > 1 and count(*) >= 3 and count(*) filter (abs(ratio - m) <= 0.02::double * m) >= 0.8::double * count(*)""")
def twin_ratios(spark, sf_dir):
    cells = _spread(_numbered(spark, sf_dir), TWINS, "p_brand", "r")
    return sheets.twin_ratios(cells.select(F.col("p_brand").alias("file"), F.col("col").cast("string").alias("sheet"), F.col("r").alias("row"), F.lit(0).alias("col"), "text"))


# flyers: two name columns and two price columns, a row per part

FLYER = ["case when p_size % 9 = 0 then null when p_size % 7 = 0 then 'Phone 555' when p_size % 5 = 1 then concat(cast(p_size as string), ' x 30') else p_name end", "case when p_size % 11 <> 0 then p_size end",
         "case when p_size % 6 = 1 then null else concat(p_type, ' ', cast(p_partkey as string)) end", "case when p_size % 4 = 0 then 'call' else null end", "case when p_size % 11 <> 0 then concat('$', cast(p_size as string), '.25') end"]
FLYER_SQL = f"""{NUMBERED_SQL}, v as (select *, try_cast(replace(text, '$', '') as double) as price from {_spread_sql('n', FLYER, 'p_brand', 'r')}),
k as (select *, dense_rank() over (partition by p_brand order by r) as k from v),
held as (select p_brand, col, count(*) as n, count(price) as prices, count(*) filter (price is null and length(text) >= 3 and not regexp_matches(text, {_sql(sheets.NO_NAME_TEXT)})) as names from k where k <= 60 group by p_brand, col having count(*) >= 3),
pc as (select p_brand, col from held where prices >= 3 and prices >= greatest(2, names)), nc as (select p_brand, col from held where names >= 3 and prices <= names and (p_brand, col) not in (select (p_brand, col) from pc)),
near as (select nc.p_brand as sheet, nc.col, pc.col as wholesale, pc.col - nc.col as error, dense_rank() over (partition by nc.p_brand order by nc.col) as k from nc join pc on pc.p_brand = nc.p_brand and pc.col - nc.col between 1 and 4)"""


@query(f"""with recursive {FLYER_SQL}, {TAKEN_SQL}, pr as (select sheet as p_brand, col, wholesale as pcol from taken where wholesale is not null),
nm as (select v.p_brand, r, v.col, text as name, pcol from v join pr on pr.p_brand = v.p_brand and pr.col = v.col), ps as (select v.p_brand, r, v.col as pcol, price from v join pr on pr.p_brand = v.p_brand and pr.pcol = v.col where price is not null),
j as (select coalesce(nm.p_brand, ps.p_brand) as p_brand, coalesce(nm.r, ps.r) as r, nm.col, name, price from nm full join ps on nm.p_brand = ps.p_brand and nm.r = ps.r and nm.pcol = ps.pcol),
rw as (select p_brand, r, max(price) as p, arg_min(name, col) filter (name is not null) as first from j group by p_brand, r),
ti as (select p_brand, r, last_value(case when p is null and length(first) between 3 and 50 and not regexp_matches(first, {_sql(sheets.NO_BANNER)}) then first end ignore nulls) over (partition by p_brand order by r rows unbounded preceding) as collection from rw)
select p_brand as file, 'flyer' as sheet, j.r as row, col, collection, name as part_number, price as base_price from j join ti using (p_brand, r) where name is not null and price between 5 and 50000
  and not regexp_matches(name, {_sql(sheets.NO_NAME)}) and length(name) <= 80 and not regexp_matches(name, {_sql(sheets.SIZE_NAME)})""")
def flyer_rows(spark, sf_dir):
    return sheets.flyer_rows(_flyers(spark, sf_dir))


def _flyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_numbered(spark, sf_dir), FLYER, "p_brand", "r").select(F.col("p_brand").alias("file"), F.lit("flyer").alias("sheet"), F.col("r").alias("row"), "col", "text")


# two readings of each sheet: a sheet per brand and type

_READ_PART = "case when cast(substring(p_brand, 7) as int) % 4 = 0 then concat(cast(p_size as {s}), ' x 12') else p_name end"
_READ_WOOD = "case cast(substring(p_brand, 7) as int) % 5 when 0 then 'Oak' when 1 then concat('col_', cast(p_size as {s})) when 2 then case when p_size % 2 = 0 then 'Cherry' end end"
_READ_PRICE = "case when cast(substring(p_brand, 7) as int) % 2 = 0 then p_retailprice else cast(p_size as double) end"


@query(f"""with m as (select p_brand as file, p_type as sheet, p_brand as collection, {_READ_PART.format(s='varchar')} as part_number, {_READ_WOOD.format(s='varchar')} as species, {_READ_PRICE} as base_price, 'matrix' as reading from part where p_type <> 'PROMO'),
f as (select p_brand, p_type, p_brand, p_name, cast(null as varchar), p_retailprice, 'flyer' as reading from part where p_size % 3 > 0), b as (select * from m union all select * from f),
j as (select file, sheet, reading, count(*) as n, coalesce(median(base_price) < 30, true) or avg(case when regexp_matches(part_number, '(?i)^\\d+(\\.\\d+)?(\\s*[x×]\\s*\\d+(\\.\\d+)?)+$') then 1 else 0 end) > 0.3
    or avg(case when regexp_matches(coalesce(species, ''), '(?i)^col_\\d+$') then 1 else 0 end) > 0.5 as low, coalesce(avg(case when species is not null then case when regexp_matches(lower(species), {_sql(grid.WOOD_HEADER)}) then 1 else 0 end end) > 0.4, false) as woods from b group by file, sheet, reading),
s as (select distinct p_brand as file, p_type as sheet from part),
c as (select s.file, s.sheet, case when coalesce(a.low and not a.woods, true) and coalesce(x.n >= 8 and not x.low, false) then 'flyer' else 'matrix' end as reading
  from s left join j a on a.file = s.file and a.sheet = s.sheet and a.reading = 'matrix' left join j x on x.file = s.file and x.sheet = s.sheet and x.reading = 'flyer')
select b.* from b join c using (file, sheet, reading)""")
def better_readings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    at = [F.col("p_brand").alias("file"), F.col("p_type").alias("sheet")]
    rows = p.filter("p_type <> 'PROMO'").select(*at, F.col("p_brand").alias("collection"), F.expr(_READ_PART.format(s="string")).alias("part_number"), F.expr(_READ_WOOD.format(s="string")).alias("species"), F.expr(_READ_PRICE).alias("base_price"))
    flyers = p.filter("p_size % 3 > 0").select(*at, F.col("p_brand").alias("collection"), F.col("p_name").alias("part_number"), F.lit(None).cast("string").alias("species"), F.col("p_retailprice").alias("base_price"))
    return sheets.better_readings(rows, flyers, p.select(*at))
