"""Sheets as cells (file, sheet, row, col, text), and the steps that bind labels to prices in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cell_price
from ..functions.text import squeeze

SHEET = ["file", "sheet"]
CELLS = "file string, sheet string, row int, col int, text string"

# Words of column headers.
WOOD_HEADER = r"oak|maple|cherry|walnut|hickory|elm|qswo|pswo|wormy|rustic|birch|ash|poplar|pine|alder|beech|mahogany|quarter|1/4 sawn|rough sawn|ruff sawn|barnwood|species|wood"
ID_HEADER = r"^(item|part|sku|model|code|style|catalog|stock|id)\s*(#|no\.?|number)?$|^(no\.?|#|item name|search all items)$|search all items| items$|^(item|part|sku|model|code|style|catalog|stock) | (item|part|sku|model|code|style|catalog|stock)$"
DESC_HEADER = r"descr|desc\.|^desc$|name|product|title"
DIM_HEADER = r"^[hwd][\"']?$|dimension|dims|size|w x d x h|w×d×h|width|height|depth|overall|wxdxh"
FINISH_HEADER = r"finished|unfinished|glazed|fin\.|unf\.|fin |unf |finshed"
PRICE_HEADER = r"^(price|wholesale|retail|cost|amount|net|dealer|whsl\.? price|list price|regular)$"
META_HEADER = r"^(unit|uom|notes?|collection|series)$"


def cleaned(cells: DataFrame) -> DataFrame:
    """Cells with single blanks, without empty ones, and with their price if they hold one."""
    out = cells.withColumn("text", squeeze(F.col("text"))).filter("text is not null and text != ''")
    return out.withColumn("price", cell_price(F.col("text")))


def header_kind(x: Column) -> Column:
    """What a column header stands for: id, desc, dim, species, finish, finish_est, price, meta, other, skip."""
    k = F.lower(squeeze(x))
    return (
        F.when((k == "") | k.rlike("^(unnamed|skip_)"), "skip")
        .when(k.rlike(r"finish(ing)?\s*(cost|est|estimate)|estimated finishing"), "finish_est")
        .when(k.rlike(ID_HEADER) & (F.length(k) < 40), "id")
        .when(k.rlike(DESC_HEADER), "desc")
        .when(k.rlike(DIM_HEADER), "dim")
        .when(k.rlike(WOOD_HEADER), "species")
        .when(k.rlike(FINISH_HEADER), "finish")
        .when(k.rlike(PRICE_HEADER), "price")
        .when(k.rlike(META_HEADER), "meta")
        .otherwise("other")
    )


def header_scores(cells: DataFrame, most_rows: int = 200) -> DataFrame:
    """(file, sheet, row, score): how much each row looks like the header of a price table."""
    kind = header_kind(F.col("text"))

    def n(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    c = cells.filter(F.col("row") < most_rows).withColumn("kind", kind)
    code = F.col("text").rlike(r"(?i)^[A-Z0-9][A-Z0-9\-_/]{1,24}$") & F.col("price").isNull() & (F.col("col") < 6)
    text = F.col("text")
    minus = 6 * n(text.rlike(r"(?i)@|phone|fax|http|township|road|street|email")) + 10 * n(F.length(text) > 80) + 8 * n(text.rlike("^[·•]")) + 2 * n(text.rlike(r"(?i)^page\s*#?$"))
    counts = [n(F.col("kind") == k).alias(k) for k in ("id", "desc", "species", "price", "finish", "dim")]
    rows = c.groupBy(*SHEET, "row").agg(*counts, n(F.col("price").isNotNull()).alias("numbers"), n(code).alias("codes"), F.count(F.lit(1)).alias("cells"), minus.alias("minus"))
    size = Window.partitionBy(*SHEET)
    rows = rows.withColumn("last", F.max("row").over(size)).withColumn("next_codes", F.when(F.lead("row").over(size.orderBy("row")) == F.col("row") + 1, F.lead("codes").over(size.orderBy("row"))).otherwise(0))
    i, s = F.col("id"), F.col("species")

    def plus(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    score = 8 * i + 6 * F.col("desc") + 4 * F.col("price") + 3 * F.col("finish") + 2 * F.col("dim") - 8 * F.col("numbers") - F.col("minus")
    score = score + F.when((s >= 2) & (i >= 1), 12).when((s >= 3) & (i == 0) & (F.col("numbers") == 0), 10).when((s >= 2) & (i == 0), 2).otherwise(0)
    score = score + plus((i >= 1) & (F.col("desc") >= 1), 30) + plus((i >= 1) & (F.col("price") >= 1), 12) + plus((i >= 1) & (s >= 2), 20) + plus((i >= 1) & (F.col("next_codes") >= 1), 8)
    score = score - plus((F.col("row") >= F.greatest(F.lit(10), (F.col("last") + 1) * 0.75)) & (i == 0) & (s == 0), 15)
    return rows.filter("cells >= 2").select(*SHEET, "row", score.cast("int").alias("score"))


def header_rows(cells: DataFrame, least: int = 6) -> DataFrame:
    """(file, sheet, header): the best scored row of each sheet, the first of equals, if it scores enough."""
    best = header_scores(cells).groupBy(*SHEET).agg(F.max(F.struct("score", -F.col("row"))).alias("b"))
    return best.filter(F.col("b.score") >= least).select(*SHEET, (-F.col("b.col2")).alias("header"))


def numbered_names(headers: DataFrame) -> DataFrame:
    """Headers (file, sheet, col, name); the second of equal names gets ` (2)`, and so on."""
    n = F.row_number().over(Window.partitionBy(*SHEET, "name").orderBy("col"))
    return headers.withColumn("_n", n).withColumn("name", F.when(F.col("_n") > 1, F.concat("name", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col("name"))).drop("_n")


def carried(rows: DataFrame, value: Column, keys: list[str], order: str, name: str) -> DataFrame:
    """rows with the last value at or above each row that is not null."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def next_row(rows: DataFrame, column: str, keys: list[str], order: str, name: str) -> DataFrame:
    """rows with a column of the row below, null where the next number is missing."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn(name, F.when(F.lead(order).over(w) == F.col(order) + 1, F.lead(column).over(w)))


def zipped(streams: DataFrame, keys: list[str], order: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """The k-th values of each kind side by side, in one shuffle; null where a stream is shorter."""
    w = Window.partitionBy(*keys, kind).orderBy(order)
    ranked = streams.filter(F.col(kind).isin(kinds)).withColumn("k", F.row_number().over(w))
    return ranked.groupBy(*keys, "k").agg(*[F.max(F.when(F.col(kind) == x, F.col(value))).alias(x) for x in kinds])


def percent_expanded(rows: DataFrame, woods: DataFrame) -> DataFrame:
    """Each row once per wood (species, pct), its price raised by the wood's share; `woods` is a workbook's list of some dozens."""
    from ..functions.money import cents

    return rows.drop("species").crossJoin(F.broadcast(woods)).withColumn("base_price", cents(F.col("base_price") * (1.0 + F.col("pct")))).drop("pct")


def unpivoted(rows: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row per filled column."""
    return rows.unpivot(ids, columns, name, value).filter(F.col(value).isNotNull())
