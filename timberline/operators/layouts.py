"""Price sheets of all layouts as long catalog rows.

A sheet is a set of cells.  Each layout names its header rows, which cells of a
header are labels, which rows carry products and where titles stand; binding a
price to the latest header above it is the same window and join for all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import WOOD
from ..functions.money import fraction
from ..functions.text import FINISHES, is_shouted, lookup, squeeze, titled
from .cells import SHEET, WOOD_HEADER, carried, cleaned, header_kind, header_rows, numbered_names

LONG = ["vendor", "collection", "part_number", "description", "dimensions", "option_key", "species", "species_tier", "finish_state", "base_price", "price_basis", "unit", "notes", "line_kind", "source_file"]

# Rows that are notices rather than products, and titles that are notices.
NOTICE = r"(?i)subject to change|purchase order|lead time|please note|table of contents|^new (?:january|february|march|april|may|june|july|august|september|october|november|december)\b"
NO_PART = r"(?i)^(?:all|none|nan|null|item\s*#?|new|new\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)(?:\s+\d{4})?)$"
NO_TITLE = r"(?i)add\s+(metal|\$)|door\s+options?|inset\s+panel|replace\s+glass|adjustable\s+shelf|markup|subtract\s+\d|subject\s+to\s+change|please\s+note|for\s+matching|see\s+page|upcharge|option:|\$50|finished\s*prices|unfinished\s*using"
CONTACT = r"(?i)phone|fax|email|@|subject to|price list|wholesale|from:|order date|due date|sealer|subtract|^d\s*w\s*h$"


def text(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


def long_rows(rows: DataFrame) -> DataFrame:
    """rows with all columns of LONG, without notices, nameless small amounts and rows without a price."""
    have = set(rows.columns)
    kinds = {"species_tier": "int", "base_price": "double"}
    rows = rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in LONG])
    rows = rows.withColumn("price_basis", F.coalesce("price_basis", F.lit("wholesale"))).withColumn("line_kind", F.coalesce("line_kind", F.lit("item")))
    part = F.coalesce(F.trim("part_number"), F.lit(""))
    return rows.filter(F.col("base_price").isNotNull() & ((F.col("base_price") >= 20) | (part != "") ) & ~F.coalesce(F.col("description").rlike(NOTICE), F.lit(False)) & ~part.rlike(NO_PART))


def title(first: Column) -> Column:
    """A section's title from a row without prices: the title, '' to clear the one before, null to keep it."""
    known = first.rlike(r"(?i)collection|series|bedroom|dining|chairs?|tables?|suite|consoles?|desks?|bookcases?|entertainment|seating|occasional|plant\s*stand|pedestal|bookshelf|shaker|mission")
    code = first.rlike(r"^[A-Z0-9][A-Z0-9\-_/]{1,16}$")
    named = first.rlike("^[A-Z]") & ~code & ~first.rlike(r"(?i)add |option|door |shelf|bracket|round rout")
    return F.when(first.rlike(NO_TITLE), "").when(F.length(first).between(3, 60) & (known | named), F.when(is_shouted(first), titled(first)).otherwise(first))


def wide(cells: DataFrame) -> DataFrame:
    """Sheets with one header: by its columns either a price per wood, a price per finish, or one price."""
    cells = cleaned(cells)
    heads = header_rows(cells)
    names = cells.join(heads, SHEET).filter("row = header").select(*SHEET, "header", "col", F.col("text").alias("name"))
    names = numbered_names(names).withColumn("kind", header_kind(F.regexp_replace("name", r"\s*\(\d+\)$", "")))
    # an estimate repeats a wood's name; the first column of a name counts
    names = names.filter(~((F.col("kind") == "species") & F.col("name").rlike(r"\(\d+\)$")))
    body = cells.join(names, [*SHEET, "col"], "left")
    heads_of = heads.withColumnRenamed("header", "top")
    body = body.join(heads_of, SHEET).filter("row > top")
    woods = names.groupBy(*SHEET).agg(F.sum((F.col("kind") == "species").cast("int")).alias("n_species"), F.sum((F.col("kind") == "finish").cast("int")).alias("n_finish"))

    def first(kind: str) -> Column:
        return F.min_by(F.when(F.col("kind") == kind, F.col("text")), F.when(F.col("kind") == kind, F.col("col")))

    small = F.lower("name").rlike("^[hwd][\"']?$")
    dims = F.when(F.col("kind") == "dim", F.struct("col", F.when(small, F.concat("name", F.when(F.col("text").rlike("[\"']$"), "").otherwise(":"), "text")).otherwise(F.col("text")).alias("t")))
    wanted = F.when(F.col("n_species") > 0, "species").when(F.col("n_finish") > 0, "finish").otherwise("price")
    body = body.join(woods, SHEET).withColumn("wanted", wanted)
    priced = F.when((F.col("kind") == F.col("wanted")) & F.col("price").isNotNull(), F.struct("col", "name", "price"))
    rows = body.groupBy(*SHEET, "row", "wanted").agg(
        first("id").alias("part"), first("desc").alias("desc"), F.max("price").alias("any"), F.min_by("text", "col").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(dims)), lambda d: d["t"]), " × ").alias("dims"), F.array_sort(F.collect_list(priced)).alias("prices"),
    )
    rows = carried(rows, F.when(F.size("prices") == 0, F.when(F.coalesce(F.col("any"), F.lit(0.0)) <= 1, title(F.col("first")))), SHEET, "row", "section")
    rows = rows.filter((F.coalesce("part", "desc") != "") & ~F.coalesce(header_kind(F.col("part")).isin("species", "desc", "dim"), F.lit(False)))
    tiers = names.filter("kind = 'species'").withColumn("tier", F.row_number().over(Window.partitionBy(*SHEET).orderBy("col"))).select(*SHEET, "col", "tier")
    rows = rows.select(*SHEET, "wanted", "part", "desc", "dims", "section", F.explode("prices").alias("p")).withColumn("col", F.col("p.col")).join(tiers, [*SHEET, "col"], "left")
    label = F.trim(F.split("p.name", r" \| ").getItem(0))
    side = F.lower(F.coalesce(F.get(F.split("p.name", r" \| "), F.lit(1)), F.when(F.col("wanted") == "finish", F.col("p.name")), F.lit("")))
    made = F.when(side.contains("unf"), "unfinished").when(side.contains("glaz"), "glazed").otherwise("finished")
    return long_rows(rows.select(
        F.nullif("section", F.lit("")).alias("collection"), F.col("part").alias("part_number"), F.coalesce("desc", "part").alias("description"), F.nullif("dims", F.lit("")).alias("dimensions"),
        F.when(F.col("wanted") != "price", label).alias("species"), F.col("tier").alias("species_tier"), F.when(F.col("wanted") != "price", made).alias("finish_state"), F.col("p.price").alias("base_price"), F.col("file").alias("source_file"),
    ))


@dataclass
class Sections:
    """A layout of repeated tables on one sheet."""

    #: Cells of a header row that label a price column, and how many make a row a header.
    label: str
    least: int = 2
    #: A header row is known by its first cell instead, its labels stand `labels_above` rows higher.
    header_first: str | None = None
    labels_above: int = 0
    #: First cells of product rows; rows in which prices stand, below the product's.
    product: str = r"^\S"
    prices_below: int = 0
    #: First cells of rows without a price that name a section.
    titles: str = r"^[A-Z]"
    no_titles: str = NO_TITLE
    #: Finishes stand in the header row under woods to their left.
    finish_under: bool = False
    description: int = 1
    dimensions: int | None = None
    #: What a label becomes.
    clean: Callable[[Column], Column] = squeeze
    finish: str = "finished"
    #: A product with one price has no label.
    lone_price_unlabelled: bool = False
    sheets: str = r".*"
    files: str = r"(?!)"
    vendor: str | None = None
    fixed: dict = field(default_factory=dict)


def sections(cells: DataFrame, layout: Sections) -> DataFrame:
    """Long rows of sheets in a layout of repeated tables."""
    cells = cleaned(cells).filter(F.col("sheet").rlike(layout.sheets))
    label = F.col("text").rlike(layout.label)
    at = lambda k: F.max(F.when(F.col("col") == k, F.col("text")))
    rows = cells.groupBy(*SHEET, "row").agg(
        F.sum(label.cast("int")).alias("labels"), F.max(F.when(F.col("col") >= 2, F.col("price"))).alias("any"), at(0).alias("c0"), at(layout.description).alias("desc"),
        *([at(layout.dimensions).alias("dims")] if layout.dimensions is not None else []),
    )
    is_header = F.coalesce(F.col("c0").rlike(layout.header_first), F.lit(False)) if layout.header_first else F.col("labels") >= layout.least
    rows = rows.withColumn("is_header", is_header)
    rows = carried(rows, F.when(F.col("is_header"), F.col("row")), SHEET, "row", "header")
    named = ~F.col("is_header") & F.col("any").isNull() & F.col("c0").rlike(layout.titles) & ~F.col("c0").rlike(layout.no_titles) & (F.length("c0") <= 70)
    rows = carried(rows, F.when(named, F.regexp_replace("c0", r"(?i),?\s*continued\s*$", "")), SHEET, "row", "section")
    heads = rows.filter("is_header").select(*SHEET, "header")
    labels = cells.filter(label).join(heads, SHEET).filter(F.col("row").between(F.col("header") - layout.labels_above, F.col("header")))
    labels = labels.groupBy(*SHEET, "header", "col").agg(F.max_by("text", "row").alias("label")) if not layout.labels_above else labels.groupBy(*SHEET, "header", "col").agg(F.min_by("text", "row").alias("label"))
    if layout.finish_under:
        under = cells.filter(F.lower("text").isin(*FINISHES)).join(heads, SHEET).filter(F.col("row") == F.col("header")).select(*SHEET, "header", "col", lookup(F.lower("text"), FINISHES).alias("side"))
        both = labels.join(under, [*SHEET, "header", "col"], "full_outer")
        both = carried(both, F.col("label"), [*SHEET, "header"], "col", "wood")
        labels = both.filter("side is not null and wood is not null").select(*SHEET, "header", "col", F.col("wood").alias("label"), "side")
    else:
        labels = labels.withColumn("side", F.lit(layout.finish))
    products = rows.filter(~F.col("is_header") & F.col("c0").rlike(layout.product) & F.col("header").isNotNull())
    if layout.prices_below:
        below = F.when(F.col("any").isNull(), F.col("row") + layout.prices_below).otherwise(F.col("row"))
    else:
        below = F.col("row")
    products = products.select(*SHEET, "header", "section", "c0", "desc", *(["dims"] if layout.dimensions is not None else []), F.col("row").alias("product"), below.alias("row"))
    priced = products.join(cells.filter("price is not null").select(*SHEET, "row", "col", "price"), [*SHEET, "row"]).join(labels, [*SHEET, "header", "col"])
    one = Window.partitionBy(*SHEET, "product")
    priced = priced.withColumn("n", F.count(F.lit(1)).over(one)).withColumn("tier", F.dense_rank().over(one.orderBy("col")))
    bare = F.lit(layout.lone_price_unlabelled) & (F.col("n") == 1)
    return long_rows(priced.select(
        F.lit(layout.vendor).alias("vendor"), F.col("section").alias("collection"), F.col("c0").alias("part_number"), F.coalesce("desc", "c0").alias("description"),
        (F.col("dims") if layout.dimensions is not None else text()).alias("dimensions"), F.when(~bare, layout.clean(F.col("label"))).alias("species"), F.when(~bare, F.col("tier")).alias("species_tier"),
        F.col("side").alias("finish_state"), F.col("price").alias("base_price"), F.col("file").alias("source_file"),
    ))


def poly_tier(x: Column) -> Column:
    k = F.lower(squeeze(x))
    return F.when(k.contains("woodgrain"), "Woodgrain Colors").when(k.contains("bright"), "Bright Colors").when(k.contains("poly") & k.contains("standard"), "Standard Poly Colors").when(k.contains("standard") & k.contains("color"), "Standard Colors").when(k == "black", "Black").when(k != "price", squeeze(x))


def fabric_grade(x: Column) -> Column:
    k = F.lower(squeeze(x))
    return F.when(k.contains("ultra"), "Ultra Leather").when(k.contains("leather"), "Genuine Leather").when(k.contains("premium"), "Premium").when(k.contains("standard"), "Standard")


def wood_group(x: Column) -> Column:
    return F.regexp_replace(squeeze(x), r"\s*,\s*", " / ")


_WOODS = "(?i)" + WOOD_HEADER
#: Layouts by name, in the order in which they are tried.
LAYOUTS = {
    "colour_tiers": Sections(label=r"(?i)standard\s*(poly\s*)?colors?|bright\s*colors?|woodgrain|poly\s*colors?|^black$|^price$", header_first=r"(?i)^item\s*(#?|no\.?|number)$", labels_above=1, product=r"^[A-Za-z][A-Za-z0-9\-_/.]{1,14}$", titles=r"(?i)\bcollection\b|accessories|frame\s*systems|furniture\s*covers|planters|benches|carts|add[\s\-]?ons?", clean=poly_tier, lone_price_unlabelled=True, files=r"(?i)patio.?kraft", sheets="(?i)^wholesale$", vendor="Patio Kraft"),
    "unfinished_and_finished_styles": Sections(label=_WOODS, header_first=None, least=2, product=r"^\S", titles=r"^[^:]+:", files=r"(?i)hillside.?chair", sheets=r"(?i)^sheet\s*([3-9]|\d\d+)$", finish_under=False, finish="unfinished", vendor="Hillside Chair"),
    "price_below": Sections(label=_WOODS, product=r"(?i)^[A-Z]{2,8}\d", prices_below=1, titles=r"(?i)pet diner|dining station|cabinet|end table|coffee|ramp|gate|toy box", files=r"(?i)maple.?lane", finish="unfinished", vendor="Maple Lane Woodshop"),
    "chair_calculator": Sections(label=_WOODS, product=r"^[A-Z]", files=r"(?i)hw.?chair", finish="unfinished", vendor="HW Chair", description=0),
    "wood_groups": Sections(label=_WOODS + "|,|/", least=2, product=r"(?i)^LA-[A-Z0-9][A-Z0-9\-_/.]*$", titles=r"^[A-Z][A-Za-z0-9 &/\-]+$", no_titles=r"(?i)^(furniture\s*options|power\s*outlets|hardware|lighting|materials|lift\s*tops|glass\s*options|quick\s*ship\s*items|notes?|options)$", description=3, dimensions=2, clean=wood_group, files=r"(?i)\blamb\b", vendor="LAMB"),
    "fabric_grades": Sections(label=r"(?i)^(standard|premium|ultra\s*leather|genuine\s*leather|leather)\s*$", product=r"^[A-Za-z0-9][A-Za-z0-9\-_/. ]{1,20}$", titles=r"(?i)\bcollection\b", clean=fabric_grade, files=r"(?i)lux\s*home", vendor="LuxHome"),
    "finishes_under_woods": Sections(label="(?i)" + WOOD[4:], header_first=r"(?i)^item\s*#?$", labels_above=2, product=r"^\S", finish_under=True, description=0, titles=r"(?i)collection|bedroom|occasionals|^[A-Z].{4,} .{3,}", clean=wood_group, files=r"(?i)windy.?acres", vendor="Windy Acres Furniture"),
}


def name_price_pairs(cells: DataFrame, reach: int = 4, low: float = 5, high: float = 50_000) -> DataFrame:
    """Flyers of names with a price to their right: each price belongs to the nearest name column at its left, within reach."""
    cells = cleaned(cells)
    w = Window.partitionBy(*SHEET, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    name = F.when(F.col("price").isNull() & (F.length("text") >= 3), F.struct("col", "text"))
    rows = cells.withColumn("name", F.last(name, ignorenulls=True).over(w)).withColumn("between", F.last(F.when(F.col("price").isNotNull(), F.col("col")), ignorenulls=True).over(w))
    alone = F.max("price").over(Window.partitionBy(*SHEET, "row")).isNull()
    rows = rows.withColumn("alone", alone)
    banner = F.when(F.col("alone") & F.length("text").between(3, 50) & ~F.col("text").rlike(CONTACT), F.col("text"))
    by_row = carried(rows.groupBy(*SHEET, "row").agg(F.min_by(banner, "col").alias("b")), F.col("b"), SHEET, "row", "section").select(*SHEET, "row", "section")
    pairs = rows.filter(F.col("price").between(low, high) & (F.col("col") - F.col("name.col") <= reach) & (F.col("between").isNull() | (F.col("between") < F.col("name.col"))))
    pairs = pairs.filter(~F.col("name.text").rlike(CONTACT) & (F.length("name.text") <= 80) & ~F.col("name.text").rlike(r"(?i)^\d+(\.\d+)?\s*[x×]\s*\d+$"))
    one = Window.partitionBy(*SHEET, F.lower("name.text"), F.round("price", 2)).orderBy("row", "col")
    pairs = pairs.withColumn("_n", F.row_number().over(one)).filter("_n = 1").join(by_row, [*SHEET, "row"])
    return long_rows(pairs.select(F.col("section").alias("collection"), F.col("name.text").alias("part_number"), F.col("name.text").alias("description"), F.lit("finished").alias("finish_state"), F.col("price").alias("base_price"), F.col("file").alias("source_file")))


def chair_matrix(cells: DataFrame, vendor: str = "FN Chair") -> DataFrame:
    """Styles with a header of woods and cloths, and rows of chair and finish below: items per wood, a charge per cloth."""
    cells = cleaned(cells)
    wood = F.col("text").rlike(r"(?i)oak|maple|cherry|walnut|hickory|qs|qtrsawn|rough\s*sawn|wormy") & F.col("col").between(2, 8)
    rows = cells.groupBy(*SHEET, "row").agg(F.sum(wood.cast("int")).alias("woods"), F.max(F.when(wood, F.col("col"))).alias("last_wood"), *[F.max(F.when(F.col("col") == k, F.col("text"))).alias(f"c{k}") for k in (0, 1)])
    rows = rows.withColumn("is_header", (F.col("woods") >= 2) & F.col("c0").isNotNull())
    for value, name in ((F.col("row"), "header"), (F.col("c0"), "style"), (F.col("last_wood"), "wide")):
        rows = carried(rows, F.when(F.col("is_header"), value), SHEET, "row", name)
    rows = carried(rows, F.when(~F.col("is_header") & F.col("c0").rlike("(?i)chair|stool|seat"), F.col("c0")), [*SHEET, "header"], "row", "chair")
    cat = F.nullif(F.regexp_extract("c1", r"(?i)^cat\.?\s*([123])$", 1), F.lit(""))
    raw = F.col("c1").rlike(r"(?i)^unf\.?$|^unfinished$")
    rows = rows.filter(~F.col("is_header") & F.col("chair").isNotNull() & (raw | cat.isNotNull())).withColumn("option", F.concat(F.lit("Cat. "), cat))
    labels = cells.select(*SHEET, F.col("row").alias("header"), "col", F.col("text").alias("label"), wood.alias("is_wood"))
    found = rows.select(*SHEET, "row", "header", "style", "chair", "option", "wide").join(cells.filter("price is not null and col >= 2").select(*SHEET, "row", "col", "price"), [*SHEET, "row"]).join(labels, [*SHEET, "header", "col"])
    part = F.concat_ws(" ", "style", "chair")
    item = F.col("is_wood")
    found = found.filter(item | (F.col("col") > F.col("wide")))
    dash = F.lit(" — ")
    return long_rows(found.select(
        F.lit(vendor).alias("vendor"), F.when(item, "Seating").otherwise("Addons").alias("collection"), F.when(item, part).otherwise(F.concat(part, dash, "label")).alias("part_number"),
        F.when(item, F.concat_ws(" — ", part, "option")).otherwise(F.concat("label", F.lit(" adder ("), part, F.lit(")"))).alias("description"), F.when(item, F.col("option")).otherwise(F.col("label")).alias("option_key"),
        F.when(item, F.col("label")).alias("species"), F.when(item & F.col("option").isNull(), "unfinished").otherwise("finished").alias("finish_state"), F.col("price").alias("base_price"),
        F.when(~item, "fabric adder").alias("notes"), F.when(item, "item").otherwise("addon").alias("line_kind"), F.col("file").alias("source_file"),
    ))


def wood_percentages(cells: DataFrame) -> DataFrame:
    """(file, species, pct) of sheets that list woods and their surcharge; Brown Maple is the base."""
    cells = cleaned(cells)
    wood = F.when(F.col("text").rlike("(?i)oak|maple|cherry|walnut|hickory|elm|qswo") & ~F.col("text").rlike(r"(?i)^wood\s*specie"), titled(F.regexp_replace("text", r"(?i)\bbr\.?\s*maple\b", "Brown Maple")))
    pct = fraction(F.col("text"))
    rows = cells.groupBy("file", "sheet", "row").agg(F.min_by(wood, F.when(wood.isNotNull(), F.col("col"))).alias("species"), F.min_by(pct, F.when(pct.isNotNull(), F.col("col"))).alias("pct")).filter("species is not null and pct is not null")
    last = rows.groupBy("file", "species").agg(F.max_by("pct", "row").alias("pct"))
    base = cells.select("file").distinct().select("file", F.lit("Brown Maple").alias("species"), F.lit(0.0).alias("pct"))
    return last.unionByName(base.join(last, ["file", "species"], "left_anti"))


def finish_charges(cells: DataFrame, vendor: str) -> DataFrame:
    """Charges from sheets of items against special finishes."""
    cells = cleaned(cells)
    mark = F.col("text").rlike(r"(?i)2-?tone|paint|glaze|rub\s*through|stain") & (F.col("col") > 0)
    heads = cells.filter(mark).groupBy(*SHEET, "row").agg(F.count(F.lit(1)).alias("n")).groupBy(*SHEET).agg(F.min("row").alias("header"))
    labels = cells.filter(mark).join(heads, SHEET).filter("row = header").select(*SHEET, "header", "col", F.col("text").alias("label"))
    items = cells.filter("col = 0").select(*SHEET, "row", F.col("text").alias("item")).filter(~F.col("item").rlike(r"(?i)custom\s*color|all\s+(keim|ocs|premier)"))
    found = cells.filter("price is not null").join(labels, [*SHEET, "col"]).filter("row > header").join(items, [*SHEET, "row"])
    dash = F.lit(" — ")
    return long_rows(found.select(F.lit(vendor).alias("vendor"), F.lit("Addons").alias("collection"), F.concat("item", dash, "label").alias("part_number"), F.concat("label", F.lit(" adder ("), "item", F.lit(")")).alias("description"), F.col("label").alias("option_key"), F.lit("finished").alias("finish_state"), F.col("price").alias("base_price"), F.lit("specialty finish").alias("notes"), F.lit("addon").alias("line_kind"), F.col("file").alias("source_file")))


def imported(cells: DataFrame) -> DataFrame:
    """Long rows of all files: each by the first layout that its name fits, else as a sheet with one header."""
    rest, parts = cells, []
    chairs = r"(?i)\bfn\s*chair"
    parts.append(chair_matrix(rest.filter(F.col("file").rlike(chairs) & F.col("sheet").rlike(r"(?i)^pl\s*(print|with\s*markup)"))))
    rest = rest.filter(~F.col("file").rlike(chairs))
    for layout in LAYOUTS.values():
        parts.append(sections(rest.filter(F.col("file").rlike(layout.files)), layout))
        rest = rest.filter(~F.col("file").rlike(layout.files))
    parts.append(wide(rest.filter(~F.col("sheet").rlike(r"(?i)^(mark\s*-?\s*up|multipliers?|instructions?|cover|index|settings?|notes?|toc|percentage|controls?)"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def markup_candidates(cells: DataFrame) -> DataFrame:
    """(file, multiplier): of numbers from 1 to 6 on markup sheets the one nearest to what builders use: 2.7, then 1.7, then the nearest to 2.7, 1 last."""
    cells = cleaned(cells).filter(F.col("sheet").rlike(r"(?i)^(mark\s*-?\s*up|multipliers?|price\s*manipulator)(\b|$)|wholesale\s*mark\s*-?\s*up") & F.col("price").between(1, 6))
    order = F.struct(F.when(F.col("price") == 2.7, 0).when(F.col("price") == 1.7, 1).when(F.col("price") == 1, 3).otherwise(2).alias("k"), F.abs(F.col("price") - 2.7).alias("d"), F.col("price").alias("p"))
    return cells.groupBy("file").agg(F.min(order).alias("b")).select("file", F.col("b.p").alias("multiplier"))
