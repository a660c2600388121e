"""Price lists as lines of text (file, page, line_no, line): statistics and ways to read rows out of them.

A file may be of any size: its lines are read in blocks of pages.  Lines may
come with a column `block` that rises with the page, dealt by file and block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze
from .running import carried_over, dealt, numbered, with_digests

# Amounts, item codes, sizes, woods, and lines that are furniture of a page.
MONEY = r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\d+(?:\.\d{2})?)"
PRICE_TOKEN = r"(?i)\$\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\$\s*\d+(?:\.\d{2})?|N/?A"
PRICE_LINE = r"(?i)^(?:\$?\s*[\d,]+(?:\.\d{2})?|N/?A)$"
CODE = r"(?i)^([A-Z]{1,6}[-/][A-Z0-9][-A-Z0-9/]{1,20}|[A-Z]?\d{3,6}[A-Z]{0,4})\s+(.+)$"
SIZE = r"(?i)^(?:solid\s+|self[- ]?store\s+|top\s+|[124]\s*leaf\s+)?(\d{1,3}\s*[\"']?\s*[x×]\s*\d{1,3}(?:\s*[\"']?\s*[x×]\s*[\d./-]+)?\s*[\"']?|\d{1,3}\s*[\"']?\s*(?:round|rd)\b|\d{1,3}\s*[\"']\s*[x×])"
SKIP = r"(?i)^(?:page\s+\d+|tableofcontents|prices?\s+subject|effective\s+|phone:|fax:|email:|accountexecutive|mainoffice|neworders|pickup|warehouse|index$|markup|upcharge|continued|standardfeatures|options:|seatoptions|pleasenote|dims?/size|l\.w\.h|d\.w\.h|std\s*=|stdprice|finished\s+(?:retail|wholesale)|yoursourcefor|ph:|www\.|http)"
PAGE_NUMBER = r"^\d{1,3}$"
SECTION = r"(?i)^(.+?\s+(?:chairs?|tables?|collection|series|beds?|stools?|benches?)|[A-Z][A-Za-z &/'-]{2,40})$"
NO_SECTION = r"(?i)^(?:item$|leaves?$|redoak|wormy|walnut|cherry|maple|oak|hickory|numberof|solid$|self.?store|specs?$|overall|sizes?$|basespecs)"
NO_PRODUCT = r"(?i)^(for |add |deduct |no |upcharge|paint )"
BLOCK_SECTION = r"(?i)chairs?|tables?|collection|beds?|stools?"
LINE_SECTION = r"(?i)table|chair|collection|pedestal|trestle|bench"
LEAVES = r"(?i)^solid$"
COLUMN_HEADS = ["item", "leaves", "number of leaves", "red oak", "wormy maple", "rustic walnut", "walnut"]
WOOD_HINTS = ["brown maple", "red oak", "wormy maple", "walnut", "rustic walnut", "cherry", "hard maple", "white oak", "qswo", "pswo", "hickory", "rustic cherry", "sap cherry", "elm", "oak", "aspen", "rough sawn", "rustic oak", "rustic hickory", "rustic wht oak", "rustic qswo"]
STREAM_CODE = r"(?i)^[A-Z]{1,6}[-/][A-Z0-9][-A-Z0-9/]{1,24}$"
STREAM_PRICE = r"^\$\s*[\d,]+(?:\.\d{2})?$"
STREAM_SIZE = r"^\d{1,3}(?:\.\d+)?[\"']?(?:\s*[xX×]\s*\d|[xX×])"
STREAM_HEAD = r"(?i)^(?:std price|code|description/?name|dims?/size|l\.w\.h|d\.w\.h)$"
STREAM_NOTE = r"(?i)^(ph:|fax:|email:|std=)"
NUMBER_CELL = r"^\d+\.?\d*$"
#: What the price columns of a list stand for where it doesn't say; with more columns than these, all are numbered.
PRICE_LABELS = ["Brown Maple / Red Oak", "Cherry / Wormy Maple", "Walnut / Premium", "Species 4", "Species 5", "Species 6", "Species 7", "Species 8"]


#: Pages of a block.
PAGES = 256


def blocked(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """lines with their block of pages, in so many parts."""
    return lines if "block" in lines.columns else dealt(lines.withColumn("block", F.floor(F.col("page") / PAGES)), parts, "file", "block")


def cleaned(lines: DataFrame) -> DataFrame:
    """Lines with single blanks, without empty ones, page numbers and furniture of a page."""
    out = lines.withColumn("line", squeeze(F.col("line"))).filter("line != ''")
    return out.filter(~F.col("line").rlike(SKIP) & ~F.col("line").rlike(PAGE_NUMBER))


def wood_header(line: Column) -> Column:
    """Whether a line names woods and is short enough to head columns."""
    low = F.lower(line)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in WOOD_HINTS]) & (F.length(line) < 80)


def price_label(n: Column, k: Column) -> Column:
    """What the k-th (from 0) of n prices stands for; null for a lone one."""
    numbered = F.concat(F.lit("Species "), (k + 1).cast("string"))
    return F.when(n > 1, F.when(n <= len(PRICE_LABELS), F.get(F.array(*map(F.lit, PRICE_LABELS)), k)).otherwise(numbered))


def statistics(lines: DataFrame) -> DataFrame:
    """(file, pages, chars, money, scanned): a file with few characters a page and few amounts is a scan."""
    by = lines.groupBy("file").agg(F.count_distinct("page").alias("pages"), F.coalesce(F.sum(F.length("line")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.regexp_count("line", F.lit(MONEY))), F.lit(0)).cast("long").alias("money"))
    return by.withColumn("scanned", (F.col("chars") < 80 * F.col("pages")) & (F.col("money") < 5))


def amounts(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(MONEY), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").cast("double"))


def _coded(text: Column) -> tuple[Column, Column]:
    part = F.nullif(F.regexp_extract(text, CODE, 1), F.lit(""))
    return part, F.when(part.isNotNull(), F.trim(F.regexp_extract(text, CODE, 2))).otherwise(text)


def _expanded(rows: DataFrame) -> DataFrame:
    """A row per price; several prices of a line stand for woods."""
    rows = rows.withColumn("_n", F.size("prices")).select("*", F.posexplode("prices").alias("pos", "base_price"))
    return rows.withColumn("species", price_label(F.col("_n"), F.col("pos"))).select(*READ)


READ = ["file", "page", "line_no", "part_number", "description", "species", "collection", "base_price", "notes"]

def _with_place(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.struct("page", "line_no")).withColumn("notes", F.lit(None).cast("string"))


def inline_prices(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Lines that hold a description and its prices."""
    rows = _with_place(cleaned(blocked(lines, parts))).withColumn("prices", amounts(F.col("line")))
    rows = rows.filter((F.size("prices") > 0) | ~wood_header(F.col("line")))
    head = F.when((F.size("prices") == 0) & ~F.col("line").rlike(r"\d") & F.length("line").between(3, 50) & F.col("line").rlike(SECTION) & ~F.col("line").rlike(NO_SECTION), F.col("line"))
    rows = carried_over(rows, {"collection": head}, ["file"], "block", "at")
    desc = squeeze(F.regexp_replace(F.regexp_replace("line", MONEY, ""), r"^[\s\-–|]+|[\s\-–|]+$", ""))
    rows = rows.withColumn("_d", desc).filter((F.size("prices") > 0) & (F.length("_d") >= 2) & ~F.col("_d").rlike(NO_PRODUCT))
    part, description = _coded(F.col("_d"))
    return _expanded(rows.withColumn("part_number", part).withColumn("description", description))


def _token_value(token: Column) -> Column:
    """A price of a token with or without a currency sign; null for N/A."""
    bare = F.regexp_replace(F.regexp_extract(token, r"[\d,]+(?:\.\d+)?", 0), ",", "")
    return F.when(~token.rlike("(?i)^N/?A$"), F.coalesce(F.get(amounts(F.when(token.startswith("$"), token).otherwise(F.concat(F.lit("$"), token))), F.lit(0)), F.nullif(bare, F.lit("")).try_cast("double")))


def item_blocks(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Items with their prices on the lines below, one a line or several on one; an item may stand on the page before its prices.

    A line either sets what is open - an item, nothing after a section or a
    line of several prices - or goes with what was set before it.  A running
    sum of the setting lines numbers the stretches between them.  Of a stretch
    that an item opened, the first prices in a row are the item's: a wood's name
    or a page's end after a price closes the row, and a second running sum of
    these tells the rows apart.  A line for leaves goes with the item above it
    only if that has no price yet, else it is an item itself.
    """
    rows = _with_place(cleaned(blocked(lines, parts)))
    line = F.col("line")
    named = line.rlike(BLOCK_SECTION) | (line.rlike(r"^\p{Lu}") & line.contains(" ") & (F.size(F.split(line, " ")) <= 5))
    woods = wood_header(line)
    kind = (
        F.when(line.rlike(PRICE_LINE), "price")
        .when(line.rlike(LEAVES), "leaf")
        .when(line.rlike(MONEY), "prices")
        .when(~line.rlike(r"\d") & F.length(line).between(3, 55) & ~woods & named, "section")
        .when(woods | F.lower(line).isin(COLUMN_HEADS), "heads")
        .otherwise("item")
    )
    rows = rows.withColumn("kind", kind).withColumn("sets", F.col("kind").isin("leaf", "prices", "section", "item"))
    # lines above a block's first item or section go with the last block that has one: what is open doesn't cross blocks then, but for the section
    opens = F.when(F.col("kind").isin("item", "section"), F.col("at"))
    ends = rows.groupBy("file", "block").agg(F.min(opens).alias("_from"), F.max(F.when(F.col("kind") == "section", F.struct("at", "line"))).alias("_last"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", "_from", F.max(F.when(F.col("_from").isNotNull(), F.col("block"))).over(past).alias("_to"), F.max("_last").over(past).alias("_section"))
    rows = with_digests(rows, ends, ["file", "block"]).withColumn("_stays", F.coalesce(F.col("at") >= F.col("_from"), F.lit(False)))
    rows = rows.withColumn("part_of", F.when(F.col("_stays"), F.col("block")).otherwise(F.col("_to"))).withColumn("_section", F.when(F.col("_stays"), F.col("_section.line")))
    rows = dealt(rows.select("file", "part_of", "page", "at", "line", "kind", "sets", "_section"), parts, "file", "part_of")

    whole = Window.partitionBy("file", "part_of")
    w = whole.orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    closes = (F.col("kind") == "heads") | (F.col("page") != F.lag("page").over(w))
    rows = rows.withColumn("_closes", F.coalesce(closes, F.lit(False)))
    rows = rows.withColumn("stretch", F.count_if("sets").over(upto)).withColumn("row_of", F.count_if("_closes").over(upto))
    # the section before the block holds for its first lines; those that came from blocks below have one in it or above
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("kind") == "section", line), ignorenulls=True).over(upto), F.first("_section").over(upto)))
    stretch = Window.partitionBy("file", "part_of", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_price = F.col("kind") == "price"
    rows = rows.withColumn("priced", F.max(is_price).over(stretch)).withColumn("first_row", F.min(F.when(is_price, F.col("row_of"))).over(stretch))

    # stretches rise with the lines, so this is the order of the lines too, and sorted already
    upto = whole.orderBy("stretch", "at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("sets"), F.struct("kind", "priced")), ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", last).withColumn("open", F.coalesce(F.col("_before.kind").isin("item", "leaf") & ~F.col("_before.priced"), F.lit(False)))
    rows = rows.withColumn("starts", (F.col("kind") == "item") | ((F.col("kind") == "leaf") & ~F.col("open")))
    leaf = F.when(F.col("kind").isin("item", "leaf"), F.struct((~F.col("starts")).alias("is"), F.lit("Solid").alias("text")))
    carries = {"item": F.when(F.col("starts"), F.struct("at", "line")), "leaf": leaf, "opener": F.when(F.col("sets"), F.col("kind"))}
    rows = rows.withColumns({name: F.last(value, ignorenulls=True).over(upto) for name, value in carries.items()})

    stacked = is_price & (F.col("row_of") == F.col("first_row")) & F.col("opener").isin("item", "leaf")
    listed = (F.col("kind") == "prices") & F.col("open")
    rows = rows.withColumn("_stacked", stacked).filter(F.col("_stacked") | listed)
    place = Window.partitionBy("file", "part_of", "stretch").orderBy("at")
    # a line of prices is a stretch without stacked ones
    rows = rows.withColumn("_k", F.row_number().over(place) - 1).withColumn("_of", F.count(F.lit(1)).over(stretch))
    rows = rows.withColumn("_t", F.when(F.col("_stacked"), F.array("line")).otherwise(F.regexp_extract_all("line", F.lit(PRICE_TOKEN), F.lit(0)))).withColumn("_size", F.size("_t").cast("long"))
    both = rows.select("*", F.posexplode("_t").alias("_pos", "_token")).withColumn("base_price", _token_value(F.col("_token"))).filter("base_price is not null")
    both = both.withColumn("pos", F.when(F.col("_stacked"), F.col("_k")).otherwise(F.col("_pos"))).withColumn("_n", F.when(F.col("_stacked"), F.col("_of")).otherwise(F.col("_size")))
    part, description = _coded(F.col("item.line"))
    told = F.when(F.col("leaf.is"), F.concat(description, F.lit(" — "), "leaf.text")).otherwise(description)
    return both.select("file", "item.at.page", "item.at.line_no", part.alias("part_number"), told.alias("description"), price_label(F.col("_n"), F.col("pos")).alias("species"), F.col("section").alias("collection"), "base_price", F.lit(None).cast("string").alias("notes"))


def price_lines(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Lines of two and more prices and nothing else belong to the last description above them."""
    rows = _with_place(cleaned(blocked(lines, parts))).withColumn("prices", amounts(F.col("line")))
    bare = F.length(F.trim(F.regexp_replace("line", PRICE_TOKEN, "")))
    rows = rows.withColumn("is_prices", (F.size("prices") >= 2) & (bare < 8))
    head = (F.size("prices") == 0) & ~F.col("line").rlike(r"\d") & F.length("line").between(3, 50) & F.col("line").rlike(LINE_SECTION)
    about = (F.size("prices") == 0) & ~head & (F.col("line").rlike(SIZE) | F.col("line").rlike(CODE) | ((F.length("line") >= 4) & ~wood_header(F.col("line"))))
    carries = {"collection": F.when(head, F.col("line")), "about": F.when(about, F.struct("at", "line")), "used": F.when(F.col("is_prices"), F.col("at"))}
    rows = carried_over(rows, carries, ["file"], "block", "at", above=("used",)).filter("is_prices and about is not null and (used is null or used < about.at)")
    part, description = _coded(F.col("about.line"))
    return _expanded(rows.withColumn("part_number", part).withColumn("description", description))


def column_streams(lines: DataFrame, parts: int | None = None, least: int = 5) -> DataFrame:
    """Pages that list codes, descriptions, sizes and prices one after the other: the k-th of each belong together."""
    rows = cleaned(blocked(lines, parts)).filter(~F.col("line").rlike(STREAM_HEAD))
    line = F.col("line")
    kind = (
        F.when(line.rlike(STREAM_CODE), "code")
        .when(line.rlike(STREAM_PRICE), "price")
        .when(line.rlike(STREAM_SIZE), "size")
        .when(line.rlike("(?i)collection$") | (line.rlike("(?i)collection") & ~line.rlike(MONEY)), "section")
        .when(F.length(line).between(4, 80) & ~line.rlike(MONEY) & ~wood_header(line) & ~line.rlike(STREAM_NOTE), "name")
    )
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    title = F.trim(F.replace(line, F.lit("Collection"), F.lit("")))
    rows = _with_place(rows)
    section = F.when(F.col("kind") == "section", F.coalesce(F.nullif(title, F.lit("")), line))
    rows = carried_over(rows, {"collection": section}, ["file"], "block", "at", within="page")
    page = Window.partitionBy("file", "block", "page")
    each = Window.partitionBy("file", "block", "page", "kind")
    kinds = ("code", "price", "size", "name")
    rows = rows.filter(F.col("kind").isin(*kinds)).withColumn("k", F.row_number().over(each.orderBy("line_no"))).withColumn("_of", F.count(F.lit(1)).over(each))
    of = {x: F.max(F.when(F.col("kind") == x, F.col("_of"))).over(page) for x in ("code", "price", "name")}
    rows = rows.withColumn("_n", F.when(of["code"].isNotNull() & of["price"].isNotNull(), F.least(of["code"], of["price"]))).withColumn("_names", of["name"]).filter(F.col("_n") >= least)
    # names that are many more than prices begin with headings: the last of them count
    far = F.abs(F.col("_names") - F.col("_n")) > F.greatest(F.lit(3.0), F.col("_n") * 0.3)
    shift = F.when((F.col("kind") == "name") & far & (F.col("_names") >= F.col("_n")), F.col("_names") - F.col("_n")).otherwise(0)
    rows = rows.withColumn("k", F.col("k") - shift).filter("k between 1 and _n")
    wide = rows.groupBy("file", "block", "page", "k").agg(*[F.max(F.when(F.col("kind") == x, F.col("line"))).alias(x) for x in kinds], F.max("collection").alias("collection"))
    priced = wide.withColumn("base_price", _token_value(F.col("price")))
    return priced.select("file", "page", F.col("k").cast("int").alias("line_no"), F.upper("code").alias("part_number"), F.coalesce("name", F.upper("code")).alias("description"), F.lit(None).cast("string").alias("species"), "collection", "base_price", F.col("size").alias("notes"))


#: Readers in the order in which equal ones win, and the rows that make a reading.
READERS = {"inline_prices": (inline_prices, 3), "item_blocks": (item_blocks, 5), "price_lines": (price_lines, 5), "column_streams": (column_streams, 5)}


def table_scores(cells: DataFrame, most_rows: int = 40, parts: int | None = None) -> DataFrame:
    """(file, table, header, rows, score) of tables of cells (file, table, row, col, text); score: amounts and numbers in the first rows.

    The first row heads the columns if two of its cells say something; rows
    without text don't count, and a table needs two.  Rows are counted before
    they meet, and numbered in blocks.
    """
    text = F.trim("text")
    amount = text.rlike(MONEY) | F.regexp_replace(text, ",", "").rlike(NUMBER_CELL)
    rows = cells.filter("file is not null and table is not null").groupBy("file", "table", "row").agg(F.count_if(text != "").alias("_says"), F.count_if((text != "") & amount).alias("_amounts"))
    heads = F.min_by("_says", "row") >= 2
    by = numbered(rows.withColumn("_full", F.col("_says") > 0), ["file", "table", "_full"], "row", "_k", parts).groupBy("file", "table")
    full, k = F.col("_full"), F.col("_k")
    # a header is the first of the rows with text, and not one of them
    plain = F.coalesce(F.sum(F.when(full & (k < most_rows), F.col("_amounts"))), F.lit(0))
    below = F.coalesce(F.sum(F.when(full & k.between(1, most_rows), F.col("_amounts"))), F.lit(0))
    out = by.agg(heads.alias("header"), F.count_if(full).alias("_rows"), plain.alias("_plain"), below.alias("_below"))
    return out.select("file", "table", "header", (F.col("_rows") - F.col("header").cast("long")).alias("rows"), F.when(F.col("header"), F.col("_below")).otherwise(F.col("_plain")).alias("score")).filter("rows >= 2")


def best_table(cells: DataFrame, least: int = 3, parts: int | None = None) -> DataFrame:
    """(file, table, header, rows, score): the table of each file with most amounts, then most rows, the first of equals."""
    best = table_scores(cells, parts=parts).groupBy("file").agg(F.max(F.struct("score", "rows", (-F.col("table")).alias("_t"), "header")).alias("b"))
    return best.filter(F.col("b.score") >= least).select("file", (-F.col("b._t")).alias("table"), "b.header", "b.rows", "b.score")


def readings(lines: DataFrame, tables: DataFrame | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of all readers, (file, reader, n, rank)): every reading of a file that found enough, most rows first; tables: cells of the tables that files hold."""
    every = None
    for k, (name, (reader, least)) in enumerate(READERS.items()):
        found = reader(lines, parts).select(*READ, F.lit(name).alias("reader"), F.lit(k + 1).alias("_order"), F.lit(least).alias("_least"))
        every = found if every is None else every.unionByName(found)
    counts = every.groupBy("file", "reader", "_order").agg(F.count(F.lit(1)).alias("n"), F.max("_least").alias("_least")).filter("n >= _least").select("file", "reader", "_order", "n")
    if tables is not None:
        counts = counts.union(best_table(tables, parts=parts).select("file", F.lit("tables"), F.lit(0), "rows"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "_order"))
    return every.select(*READ, "reader"), counts.select("file", "reader", "n", rank.alias("rank"))


def best_reading(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Of each file the rows of the reader that found most, the first of equals, if it found enough."""
    rows, counts = readings(lines, parts=parts)
    # one row a file; rows of one file are too many to meet it in one task
    return rows.join(F.broadcast(counts.filter("rank = 1").select("file", "reader")), ["file", "reader"]).select(*READ, "reader")


def price_links(pages: DataFrame) -> DataFrame:
    """(page_id, href) of distinct links in HTML, & restored."""
    href = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"(?i)<a[^>]+href=[\"']([^\"']+)[\"']"), F.lit(1)), lambda x: F.regexp_replace(x, "&amp;", "&"))))
    return pages.select("page_id", href.alias("href"))
