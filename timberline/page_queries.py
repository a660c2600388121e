"""Queries over lines of price lists, with their SQL: blocks of items and prices, other readings, and the best of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import pages
from .operators.running import numbered
from .plans.catalog import parts_of, table
from .plans.price_lists import LINES_A_PART, PAGE_LINES_SQL, STREAM_LINES_SQL, page_lines, stream_lines, typed
from .queries import query


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WOODS = "(" + " or ".join(f"contains(lower(line), '{w}')" for w in pages.WOOD_HINTS) + ") and length(line) < 80"
_HEADS = ", ".join(f"'{x}'" for x in pages.COLUMN_HEADS)
_DIGIT = r"regexp_matches(line, '\d')"
CLEAN_SQL = f"""{PAGE_LINES_SQL.strip()},
squeezed as (select file, page, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) as line from raw_lines),
clean as (select * from squeezed where line <> '' and not regexp_matches(line, {_sql(pages.SKIP)}) and not regexp_matches(line, {_sql(pages.PAGE_NUMBER)}))"""


# MONEY takes up to three digits where no comma follows
def _amount(x: str) -> str:
    return f"try_cast(replace(regexp_extract({x}, {_sql(pages.MONEY)}, 1), ',', '') as double)"


def _coded(x: str) -> str:
    return f"nullif(regexp_extract({x}, {_sql(pages.CODE)}, 1), '') as part_number, case when regexp_matches({x}, {_sql(pages.CODE)}) then trim(regexp_extract({x}, {_sql(pages.CODE)}, 2)) else {x} end"


LABEL_SQL = f"case when n > 1 then case when n <= {len(pages.PRICE_LABELS)} then ([{', '.join(map(_sql, pages.PRICE_LABELS))}])[k + 1] else concat('Species ', cast(k + 1 as varchar)) end end"

#: A state machine over the lines of each file, one line a step.
BLOCKS_SQL = f"""
kinds as (select *, case when regexp_matches(line, {_sql(pages.PRICE_LINE)}) then 'price' when lower(line) = 'solid' then 'leaf' when regexp_matches(line, {_sql(pages.MONEY)}) then 'prices'
    when not {_DIGIT} and length(line) between 3 and 55 and not ({_WOODS}) and (regexp_matches(line, {_sql(pages.BLOCK_SECTION)}) or (regexp_matches(line, '^[A-Z]') and contains(line, ' ') and len(string_split(line, ' ')) <= 5)) then 'section'
    when ({_WOODS}) or lower(line) in ({_HEADS}) then 'heads' else 'item' end as kind from clean),
steps as (select file, page, line_no, line, kind, row_number() over (partition by file order by page, line_no) as seq,
    case when kind = 'price' then [case when upper(replace(line, '/', '')) = 'NA' then null else {_amount("concat('$', ltrim(line, '$'))")} end]
      when kind = 'prices' then list_transform(regexp_extract_all(line, {_sql(pages.PRICE_TOKEN)}), lambda t: case when upper(replace(t, '/', '')) = 'NA' then null else {_amount("t")} end) else [] end as amounts from kinds
  union all select file, max(page) + 1, 0, '', 'end', count(*) + 1, [] from kinds group by file),
state as (
  select file, 0::bigint as seq, null::integer as page, null::varchar as item, null::integer as item_page, null::integer as item_line, false as solid, null::varchar as section, []::double[] as held,
    null::struct(item varchar, page integer, line_no integer, solid boolean, section varchar, amounts double[]) as done from (select distinct file from kinds)
  union all
  select file, seq, page, case when opens then line when closes then null else item1 end, case when opens then page else item_page end, case when opens then line_no else item_line end,
    case when opens then false when leaf then true else solid end, case when kind = 'section' then line else section end, case when kind = 'price' and item1 is not null then list_concat(held1, amounts) else held1 end,
    case when flush then {{'item': item, 'page': item_page, 'line_no': item_line, 'solid': solid, 'section': section, 'amounts': held}}
      when kind = 'prices' and item1 is not null then {{'item': item1, 'page': item_page, 'line_no': item_line, 'solid': solid, 'section': section, 'amounts': amounts}} end
  from (select *, kind = 'leaf' and item1 is not null as leaf, kind = 'item' or (kind = 'leaf' and item1 is null) as opens, kind in ('section', 'prices') as closes from
    (select s.item, s.item_page, s.item_line, s.solid, s.section, s.held, l.*, len(s.held) > 0 and (l.kind <> 'price' or l.page <> s.page) as flush,
      case when len(s.held) > 0 and (l.kind <> 'price' or l.page <> s.page) then null else s.item end as item1, case when len(s.held) > 0 and (l.kind <> 'price' or l.page <> s.page) then [] else s.held end as held1
     from state s join steps l on l.file = s.file and l.seq = s.seq + 1))),
blocks as (select file, done.item as item, done.page as page, done.line_no as line_no, done.solid as solid, done.section as collection, len(done.amounts) as n, unnest(range(len(done.amounts))) as k, unnest(done.amounts) as base_price from state where done is not null),
item_blocks as (select file, page, line_no, part_number, case when solid then concat(d, ' — Solid') else d end as description, {LABEL_SQL} as species, collection, base_price, null::varchar as notes
  from (select *, {_coded('item')} as d from blocks where base_price is not null))"""
INLINE_SQL = f"""
i0 as (select *, regexp_extract_all(line, {_sql(pages.MONEY)}, 1) as prices from clean), i1 as (select * from i0 where len(prices) > 0 or not ({_WOODS})),
i2 as (select *, last_value(case when len(prices) = 0 and not {_DIGIT} and length(line) between 3 and 50 and regexp_matches(line, {_sql(pages.SECTION)}) and not regexp_matches(line, {_sql(pages.NO_SECTION)}) then line end ignore nulls)
    over (partition by file order by page, line_no rows unbounded preceding) as collection, trim(regexp_replace(regexp_replace(regexp_replace(line, {_sql(pages.MONEY)}, '', 'g'), '^[\\s\\-–|]+|[\\s\\-–|]+$', '', 'g'), '\\s+', ' ', 'g')) as text from i1),
i3 as (select *, len(prices) as n, unnest(range(len(prices))) as k, unnest(prices) as price from i2 where len(prices) > 0 and length(text) >= 2 and not regexp_matches(text, {_sql(pages.NO_PRODUCT)})),
inline_prices as (select file, page, line_no, {_coded('text')} as description, {LABEL_SQL} as species, collection, cast(replace(price, ',', '') as double) as base_price, null::varchar as notes from i3)"""
LINES_SQL = f"""
l0 as (select *, regexp_extract_all(line, {_sql(pages.MONEY)}, 1) as prices, row_number() over (partition by file order by page, line_no) as seq from clean),
l1 as (select *, len(prices) >= 2 and length(trim(regexp_replace(line, {_sql(pages.PRICE_TOKEN)}, '', 'g'))) < 8 as is_prices, len(prices) = 0 and not {_DIGIT} and length(line) between 3 and 50 and regexp_matches(line, {_sql(pages.LINE_SECTION)}) as head from l0),
l2 as (select *, len(prices) = 0 and not head and (regexp_matches(line, {_sql(pages.SIZE)}) or regexp_matches(line, {_sql(pages.CODE)}) or (length(line) >= 4 and not ({_WOODS}))) as about from l1),
l3 as (select p.file, p.page, p.line_no, p.prices, (select max(a.seq) from l2 a where a.file = p.file and a.seq < p.seq and a.about) as about, (select max(a.seq) from l2 a where a.file = p.file and a.seq < p.seq and a.is_prices) as used,
    (select max(a.seq) from l2 a where a.file = p.file and a.seq < p.seq and a.head) as top from l2 p where is_prices),
l4 as (select l3.file, l3.page, l3.line_no, a.line as text, h.line as collection, len(l3.prices) as n, unnest(range(len(l3.prices))) as k, unnest(l3.prices) as price
  from l3 join l0 a on a.file = l3.file and a.seq = l3.about left join l0 h on h.file = l3.file and h.seq = l3.top where used is null or used < about),
price_lines as (select file, page, line_no, {_coded('text')} as description, {LABEL_SQL} as species, collection, cast(replace(price, ',', '') as double) as base_price, null::varchar as notes from l4)"""
_ALL = ", ".join(pages.READ)
STREAMS_SQL = f"""
k0 as (select file, page, line_no, line, case when regexp_matches(line, {_sql(pages.STREAM_CODE)}) then 'code' when regexp_matches(line, {_sql(pages.STREAM_PRICE)}) then 'price' when regexp_matches(line, {_sql(pages.STREAM_SIZE)}) then 'size'
  when regexp_matches(line, '(?i)collection') then 'section' when length(line) between 4 and 80 and not ({_WOODS}) and not regexp_matches(line, {_sql(pages.STREAM_NOTE)}) then 'name' end as kind from clean where not regexp_matches(line, {_sql(pages.STREAM_HEAD)})),
lists as (select file, page, list(line order by line_no) filter (kind = 'code') as codes, list(line order by line_no) filter (kind = 'price') as prices, list(line order by line_no) filter (kind = 'size') as sizes, coalesce(list(line order by line_no) filter (kind = 'name'), []) as names from k0 group by file, page),
ns as (select *, least(len(codes), len(prices)) as n from lists where len(codes) >= 5 and len(prices) >= 5),
cut as (select *, case when abs(len(names) - n) > greatest(3, n * 0.3) and len(names) >= n then names[len(names) - n + 1:] else names end as told, unnest(range(1, n + 1)) as k from ns),
column_streams as (select file, page, cast(k as integer) as line_no, upper(codes[k]) as part_number, coalesce(told[k], upper(codes[k])) as description, cast(null as varchar) as species,
  (select coalesce(nullif(trim(replace(line, 'Collection', '')), ''), line) from k0 where k0.file = cut.file and k0.page <= cut.page and kind = 'section' order by k0.page desc, line_no desc limit 1) as collection,
  cast(replace(prices[k], '$', '') as double) as base_price, sizes[k] as notes from cut)"""
BEST_SQL = f"""
every as (select {_ALL}, 'inline_prices' as reader, 1 as o, 3 as least from inline_prices union all select {_ALL}, 'item_blocks', 2, 5 from item_blocks union all select {_ALL}, 'price_lines', 3, 5 from price_lines union all select {_ALL}, 'column_streams', 4, 5 from column_streams),
counted as (select file, reader, o, count(*) as n from every group by file, reader, o having count(*) >= max(least)),
ranked as (select file, reader, n, cast(row_number() over (partition by file order by n desc, o) as integer) as rank from counted)"""


def _parts(spark, sf_dir):
    return parts_of(spark, sf_dir, "part", LINES_A_PART)


@query(f"with recursive {CLEAN_SQL}, {BLOCKS_SQL} select {_ALL} from item_blocks")
def item_blocks(spark, sf_dir):
    return pages.item_blocks(page_lines(spark, sf_dir), _parts(spark, sf_dir))


@query(f"with {CLEAN_SQL}, {INLINE_SQL} select {_ALL} from inline_prices")
def inline_prices(spark, sf_dir):
    return pages.inline_prices(page_lines(spark, sf_dir), _parts(spark, sf_dir))


@query(f"with {CLEAN_SQL}, {LINES_SQL} select {_ALL} from price_lines")
def price_lines(spark, sf_dir):
    return pages.price_lines(page_lines(spark, sf_dir), _parts(spark, sf_dir))


@query(f"with recursive {CLEAN_SQL}, {BLOCKS_SQL}, {INLINE_SQL}, {LINES_SQL}, {STREAMS_SQL}, {BEST_SQL} select file, reader, n, rank from ranked")
def page_readings(spark, sf_dir):
    return pages.readings(page_lines(spark, sf_dir), parts=_parts(spark, sf_dir))[1]


@query(f"with recursive {CLEAN_SQL}, {BLOCKS_SQL}, {INLINE_SQL}, {LINES_SQL}, {STREAMS_SQL}, {BEST_SQL} select {_ALL}, reader from every join ranked using (file, reader) where rank = 1")
def best_reading(spark, sf_dir):
    return pages.best_reading(page_lines(spark, sf_dir), _parts(spark, sf_dir))


@query(f"""with {CLEAN_SQL.replace(PAGE_LINES_SQL.strip(), STREAM_LINES_SQL.strip())},
{STREAMS_SQL} select {_ALL} from column_streams""")
def column_streams(spark, sf_dir):
    return pages.column_streams(stream_lines(spark, sf_dir))


# tables in pages: of each brand and type one, a row per part


def _tables(spark, sf_dir):
    p = numbered(typed(table(spark, sf_dir, "part"), "table"), ["p_brand", "p_type"], "p_partkey", "row", parts_of(spark, sf_dir, "part")).withColumn("row", F.col("row").cast("int"))
    texts = F.array(F.when(F.col("row") == 0, F.lit("Item")).otherwise(F.col("p_name")), F.when(F.col("p_size") > 25, F.concat(F.lit("$"), F.col("p_size"), F.lit(".00"))).otherwise(""), F.when(F.col("p_size") % 3 == 0, F.lit("1,200")).when(F.col("p_size") % 3 == 1, F.lit(" ")).otherwise("call"))
    return p.select(F.col("p_brand").alias("file"), "table", "row", F.posexplode(texts).alias("col", "text"))


@query(r"""with p as (select *, row_number() over (partition by p_brand, p_type order by p_partkey) - 1 as row, dense_rank() over (partition by p_brand order by p_type) as t from part),
c as (select p_brand as file, t, row, trim(unnest([case when row = 0 then 'Item' else p_name end, case when p_size > 25 then concat('$', p_size, '.00') else '' end, case p_size % 3 when 0 then '1,200' when 1 then ' ' else 'call' end])) as text from p),
h as (select file, t, count(*) >= 2 as header from c where row = 0 and text <> '' group by file, t),
b as (select c.*, header, dense_rank() over (partition by file, t order by row) as k from c join h using (file, t) where text <> '' and (row > 0 or not header)),
s as (select file, t, bool_or(header) as header, max(k) as rows, count(*) filter (k <= 40 and (regexp_matches(text, '\$\s*\d') or regexp_matches(replace(text, ',', ''), '^\d+\.?\d*$'))) as score from b group by file, t having max(k) >= 2)
select file, cast(t as integer) as "table", header, rows, score from s where score >= 3 qualify row_number() over (partition by file order by score desc, rows desc, t) = 1""")
def best_table(spark, sf_dir):
    return pages.best_table(_tables(spark, sf_dir), parts=parts_of(spark, sf_dir, "part"))
