"""Sheets before their rows are read: headers of one or two rows, columns that belong together, and which of a file's sheets count.

A sheet is a set of cells (file, sheet, row, col, text) as in `cells`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cell_price
from ..functions.text import squeeze
from .cells import DESC_HEADER, DIM_HEADER, FINISH_HEADER, ID_HEADER, SHEET, WOOD_HEADER, carried, header_rows, numbered_names

# Headers that end the price columns, woods in short, estimates that are no finish, and sheets of copies.
MARKUP_HEADER = r"(?i)mark\s*up|multiplier"
SHORT_WOODS = r"(?i)\b(oak|maple|cherry|walnut|hick(?:ory)?|qswo|qsw?|ch|hm|ro|bsm|rustic)\b"
NO_FINISH = r"finishing cost|finish est|est\. finishing|estimated finishing"
RETAIL_SHEET, WHOLESALE_SHEET = r"(?i)\bretail\b", r"(?i)\bwholesale\b"
MARKED_UP_SHEET, ANY_MARKUP, PLAIN_SHEET = r"(?i)\bmark\s*-?\s*up\b", r"(?i)mark\s*-?\s*up", r"(?i)price\s*list|pricelist"
CONTROL_SHEET = r"(?i)^(mark\s*-?\s*up|multipliers?|price\s*manipulator)(\b|$)|wholesale\s*mark\s*-?\s*up|^mark\s*-?\s*up\s"
# What names and prices of a flyer are, and how far apart they may stand.
NO_NAME_TEXT = r"(?i)^(d\s*w\s*h|phone|fax|email|qty|\$)$"
NO_BANNER = r"(?i)phone|fax|email|@|subject to|price list|wholesale|from:|order date"
NO_NAME = r"(?i)phone|fax|email|@|subject to|price list|wholesale|from:|order date|due date|sealer|subtract|finished lasered|^d\s*w\s*h$|joel martin|m\s*&\s*m enterprises"
SIZE_NAME = r"(?i)^\d+(\.\d+)?\s*[x×]\s*\d+$"
FLYER_ROWS, FLYER_REACH, FLYER_PRICES = 60, 4, (5, 50_000)


def assigned(pairs: DataFrame, keys: list[str], seeker: str, target: str, cost: str) -> DataFrame:
    """(*keys, seeker, target, cost): seekers, in their order, each take the cheapest target that none before took; of equal ones the first.

    The pairs of one key are folded in one row; a key is a sheet, whose
    columns are few.  A seeker without a free target goes.
    """
    wishes = pairs.groupBy(*keys, seeker).agg(F.array_sort(F.collect_list(F.struct(cost, target))).alias("_wishes"))
    lists = wishes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(seeker, "_wishes"))).alias("_all"))
    kind = dict(pairs.dtypes)
    none = F.array().cast(f"array<struct<{seeker}:{kind[seeker]},{cost}:{kind[cost]},{target}:{kind[target]}>>")

    def take(got: Column, one: Column) -> Column:
        free = F.get(F.filter(one["_wishes"], lambda w: ~F.exists(got, lambda g: g[target] == w[target])), F.lit(0))
        entry = F.struct(one[seeker].alias(seeker), free[cost].alias(cost), free[target].alias(target))
        return F.when(free.isNull(), got).otherwise(F.concat(got, F.array(entry)))

    found = lists.select(*keys, F.explode(F.aggregate("_all", none, take)).alias("_g"))
    return found.select(*keys, F.col(f"_g.{seeker}"), F.col(f"_g.{target}"), F.col(f"_g.{cost}"))


def is_finish_header(x: Column) -> Column:
    k = F.lower(squeeze(x))
    return F.coalesce(k.rlike(FINISH_HEADER) & ~k.rlike(NO_FINISH), F.lit(False))


def headed(cells: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Names of the columns of each sheet (file, sheet, col, name), and (file, sheet, header, body): where the header stands and the row after which products begin.

    Below a header of woods a second row may say finished or unfinished: if two
    of its cells do, each such cell takes the wood last named at its left, as
    `wood | finish`.  A label that is no wood ends a wood's columns, a markup
    column ends them all.  Only the first groups count up to the first that is
    incomplete: one with no unfinished column in a sheet that has such, or no
    finished one.  Other columns are named `skip_...`.  Equal names are numbered.
    """
    cells = cells.withColumn("text", squeeze(F.col("text"))).filter("text != ''")
    heads = header_rows(cells.withColumn("price", cell_price(F.col("text")))) if heads is None else heads
    sheet = Window.partitionBy(*SHEET)
    places = cells.join(heads, SHEET).withColumn("next", F.min(F.when(F.col("row") > F.col("header"), F.col("row"))).over(sheet))
    # the cells of a sheet stay in the part that they were dealt to; a column's place is that among those that have cells
    top, bottom = (F.max(F.when(F.col("row") == F.col(x), F.col("text"))).alias(y) for x, y in (("header", "top"), ("next", "bottom")))
    grid = places.groupBy(*SHEET, "header", "next", "col").agg(top, bottom).withColumn("j", F.row_number().over(sheet.orderBy("col")) - 1)
    upto = sheet.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("finish", is_finish_header(F.col("bottom"))).withColumn("two", F.count_if("finish").over(sheet) >= 2)
    past = F.coalesce(F.col("top").rlike(MARKUP_HEADER), F.lit(False)) | F.coalesce(F.col("bottom").rlike(MARKUP_HEADER), F.lit(False))
    grid = grid.withColumn("past", F.max(past).over(upto))
    low = F.lower("top")
    says = F.col("top").isNotNull() & ~is_finish_header(F.col("top")) & ~low.startswith("col_") & ~(low.rlike(ID_HEADER) & (F.length(low) < 40)) & ~low.rlike(DESC_HEADER) & ~low.rlike(DIM_HEADER)
    wood = low.rlike(WOOD_HEADER) | F.col("top").rlike(SHORT_WOODS)
    grid = grid.withColumn("wood", F.last(F.when(says, F.when(wood, F.col("top")).otherwise("")), ignorenulls=True).over(upto))
    blank = F.concat(F.lit("col_"), F.col("j").cast("string"))
    bound = F.col("finish") & (F.coalesce("wood", F.lit("")) != "")
    two = F.when(F.col("past"), F.concat(F.lit("skip_"), F.col("j").cast("string"))).when(bound, F.concat_ws(" | ", "wood", "bottom")).otherwise(F.coalesce("top", "bottom", blank))
    grid = grid.withColumn("name", F.when(F.col("two"), two).otherwise(F.coalesce("top", blank)))

    part = F.split("name", r" \| ", 2)
    grid = grid.withColumn("group", F.when(F.col("two") & F.col("name").contains(" | "), part.getItem(0))).withColumn("side", F.lower(F.get(part, F.lit(1))))
    unf = F.col("side").contains("unf")
    group, grouped = Window.partitionBy(*SHEET, "group"), F.col("group").isNotNull()
    grid = grid.withColumn("_first", F.when(grouped, F.min("j").over(group))).withColumn("_unf", F.max(F.when(grouped, unf)).over(group)).withColumn("_fin", F.max(F.when(grouped, F.col("side").contains("fin") & ~unf)).over(group))
    grid = grid.withColumn("_any", F.max("_unf").over(sheet))
    whole = F.when(F.col("_any"), F.col("_fin") & F.col("_unf")).otherwise(F.col("_fin") | F.col("_unf"))
    grid = grid.withColumn("complete", F.min(whole).over(sheet.orderBy("_first").rangeBetween(Window.unboundedPreceding, 0)))
    name = F.when(F.col("group").isNotNull() & ~F.col("name").startswith("skip_") & ~F.col("complete"), F.concat(F.lit("skip_"), "name")).otherwise(F.col("name"))
    names = numbered_names(grid.select(*SHEET, "col", name.alias("name")))
    body = grid.groupBy(*SHEET, "header").agg(F.max(F.when(F.col("two"), F.col("next")).otherwise(F.col("header"))).alias("body"))
    return names, body


def counted_sheets(sheets: DataFrame) -> DataFrame:
    """sheets (file, sheet, ...) without copies: retail ones where the file has a wholesale one, marked-up ones where it has a plain price list.

    A marked-up sheet's prices are those of its twin times a factor, so both
    together would give each product twice.  Sheets that only hold markups are
    no copies.
    """
    name = F.trim("sheet")
    marked = name.rlike(MARKED_UP_SHEET) & ~name.rlike(CONTROL_SHEET)
    file = Window.partitionBy("file")
    out = sheets.withColumn("_wholesale", F.max(name.rlike(WHOLESALE_SHEET)).over(file)).withColumn("_plain", F.max(name.rlike(PLAIN_SHEET) & ~name.rlike(ANY_MARKUP)).over(file))
    return out.filter(~(name.rlike(RETAIL_SHEET) & F.col("_wholesale")) & ~(marked & F.col("_plain"))).drop("_wholesale", "_plain")


def without_copies(cells: DataFrame) -> DataFrame:
    """The cells of the sheets that count; the list of sheets is made by one aggregate and joined back."""
    return cells.join(counted_sheets(cells.select(*SHEET).distinct()), SHEET, "left_semi")


def twin_ratios(cells: DataFrame, error: float = 0.02, least: int = 3, share: float = 0.8) -> DataFrame:
    """(file, sheet, twin, ratio, n): sheets of a file whose prices at the same places are another's times one factor above 1.

    Finds copies whose names don't tell: of the cells priced in both, `share`
    lie within `error` of the median ratio.
    """
    priced = cells.withColumn("price", cell_price(F.col("text"))).filter("price is not null").select("file", "sheet", "row", "col", "price")
    other = priced.select("file", F.col("sheet").alias("twin"), "row", "col", F.col("price").alias("_p"))
    ratio = F.col("price") / F.col("_p")
    pairs = priced.join(other, ["file", "row", "col"]).filter("sheet != twin").withColumn("ratio", ratio)
    # sizes and counts stand at the same places unchanged and tell nothing
    pairs = pairs.filter(F.abs(F.col("ratio") - 1) > 1e-9)
    middle = pairs.groupBy("file", "sheet", "twin").agg(F.expr("percentile_disc(0.5) within group (order by ratio)").alias("_m"))
    near = F.abs(F.col("ratio") - F.col("_m")) <= error * F.col("_m")
    found = pairs.join(middle, ["file", "sheet", "twin"]).groupBy("file", "sheet", "twin").agg(F.max("_m").alias("ratio"), F.count(F.lit(1)).alias("n"), F.count_if(near).alias("_near"))
    return found.filter((F.col("ratio") > 1) & (F.col("n") >= least) & (F.col("_near") >= share * F.col("n"))).drop("_near")


def flyer_pairs(cells: DataFrame) -> DataFrame:
    """(file, sheet, col, price_col): columns of names with the price column each takes, the nearest free one at its right within reach.

    What a column holds is judged by the first rows of the sheet.
    """
    seen = cells.withColumn("text", squeeze(F.col("text"))).filter("text != ''").withColumn("price", cell_price(F.col("text")))
    first = Window.partitionBy(*SHEET).orderBy("row")
    seen = seen.withColumn("_k", F.dense_rank().over(first)).filter(F.col("_k") <= FLYER_ROWS)
    name = F.col("price").isNull() & (F.length("text") >= 3) & ~F.col("text").rlike(NO_NAME_TEXT)
    held = seen.groupBy(*SHEET, "col").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("prices"), F.count_if(name).alias("names")).filter("n >= 3")
    is_price = (F.col("prices") >= 3) & (F.col("prices") >= F.greatest(F.lit(2), "names"))
    is_name = ~is_price & (F.col("names") >= 3) & (F.col("prices") <= F.col("names"))
    prices = held.filter(is_price).select(*SHEET, F.col("col").alias("price_col"))
    pairs = held.filter(is_name).select(*SHEET, "col").join(prices, SHEET).withColumn("far", F.col("price_col") - F.col("col")).filter(F.col("far").between(1, FLYER_REACH))
    return assigned(pairs, SHEET, "col", "price_col", "far").drop("far")


def flyer_rows(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, col, collection, part_number, base_price): names with the prices beside them, on sheets that repeat name and price columns.

    A row without any price whose first name is a title names the collection
    of the rows below it.
    """
    cells = cells.withColumn("text", squeeze(F.col("text"))).filter("text != ''")
    pairs = flyer_pairs(cells)
    names = cells.join(pairs, [*SHEET, "col"]).select(*SHEET, "row", "col", "price_col", F.col("text").alias("name"))
    priced = cells.withColumn("price", cell_price(F.col("text"))).filter("price is not null").select(*SHEET, "row", F.col("col").alias("price_col"), "price")
    priced = priced.join(pairs.select(*SHEET, "price_col"), [*SHEET, "price_col"], "left_semi")
    both = names.join(priced, [*SHEET, "row", "price_col"], "full_outer")
    rows = both.groupBy(*SHEET, "row").agg(F.max("price").alias("_any"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("col"))).alias("_first"))
    banner = F.when(F.col("_any").isNull() & F.length("_first").between(3, 50) & ~F.col("_first").rlike(NO_BANNER), F.col("_first"))
    titles = carried(rows, banner, SHEET, "row", "collection").select(*SHEET, "row", "collection")
    good = F.col("price").between(*FLYER_PRICES) & ~F.col("name").rlike(NO_NAME) & (F.length("name") <= 80) & ~F.col("name").rlike(SIZE_NAME)
    return both.filter("name is not null and price is not null").filter(good).join(titles, [*SHEET, "row"]).select(*SHEET, "row", "col", "collection", F.col("name").alias("part_number"), F.col("price").alias("base_price"))


def judged(rows: DataFrame) -> DataFrame:
    """(file, sheet, n, low, woods) of rows (file, sheet, part_number, species, base_price): whether a reading of a sheet is junk, and whether it found real woods.

    Junk: a median price under 30, more than 30 % of parts that are sizes, or
    half of the woods that are numbers of columns.
    """
    part, wood = F.coalesce(F.col("part_number"), F.lit("")), F.coalesce(F.col("species"), F.lit(""))
    size = part.rlike(r"(?i)^\d+(\.\d+)?(\s*[x×]\s*\d+(\.\d+)?)+$")
    by = rows.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("n"), F.median("base_price").alias("_median"), F.avg(size.cast("int")).alias("_sizes"), F.avg(wood.rlike(r"(?i)^col_\d+$").cast("int")).alias("_numbers"),
        F.avg(F.when(F.col("species").isNotNull(), F.lower("species").rlike(WOOD_HEADER).cast("int"))).alias("_woods"),
    )
    low = F.coalesce(F.col("_median") < 30, F.lit(True)) | (F.col("_sizes") > 0.3) | (F.col("_numbers") > 0.5)
    return by.select(*SHEET, "n", low.alias("low"), F.coalesce(F.col("_woods") > 0.4, F.lit(False)).alias("woods"))


def better_readings(rows: DataFrame, flyers: DataFrame, sheets: DataFrame, least: int = 8) -> DataFrame:
    """rows, but of the sheets whose reading is junk without woods the flyer's rows, if these are good and enough; with a column `reading`.

    rows and flyers: (file, sheet, collection, part_number, species, base_price);
    sheets: all sheets (file, sheet).  Each sheet is decided by itself.
    """
    first = judged(rows).select(*SHEET, (F.col("low") & ~F.col("woods")).alias("junk"))
    other = judged(flyers).filter((F.col("n") >= least) & ~F.col("low")).select(*SHEET, F.lit(True).alias("good"))
    choice = sheets.select(*SHEET).distinct().join(first, SHEET, "left").join(other, SHEET, "left")
    choice = choice.select(*SHEET, F.when(F.coalesce("junk", F.lit(True)) & F.coalesce("good", F.lit(False)), "flyer").otherwise("matrix").alias("reading"))
    columns = [*SHEET, "collection", "part_number", "species", "base_price"]
    both = rows.select(*columns, F.lit("matrix").alias("reading")).union(flyers.select(*columns, F.lit("flyer")))
    return both.join(choice, [*SHEET, "reading"]).select(*columns, "reading")
