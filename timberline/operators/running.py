"""Running values over groups of any size: a group is cut into blocks, which are worked by themselves and told what stood before them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of an order that share a block, where it is cut by values.
BLOCK_VALUES = 2**16


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """rows in so many parts by their keys, a number that adaptive execution leaves alone; as they are if parts is None."""
    return rows.repartition(parts, *keys) if parts else rows


def with_digests(rows: DataFrame, digests: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of digests, a row a block or file, which every task gets whole; null keys are equal."""
    apart = digests.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(apart[f"_of_{k}"]) for k in keys])
    return rows.join(F.broadcast(apart), same, "left").drop(*[f"_of_{k}" for k in keys])


def numbered(rows: DataFrame, keys: list[str], order: str, name: str, parts: int | None = None) -> DataFrame:
    """rows with their place by a number, order, among those of equal keys, from 0; in so many parts."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / BLOCK_VALUES))
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)) - 1
    placed = dealt(rows, parts, *keys, "_block").withColumn("_here", here)
    return with_digests(placed, before, [*keys, "_block"]).withColumn(name, F.col("_here") + F.col("_before")).drop("_block", "_here", "_before")


def carried_over(rows: DataFrame, values: dict[str, Column], keys: list[str], block: str, order: str, above: tuple[str, ...] = (), within: str | None = None) -> DataFrame:
    """rows with the last of each value at or above each row of its keys that is not null; of names in `above`, above the row.

    block rises with order and cuts each group; a group's blocks are met as one
    row each.  With `within`, a column that rises with order, a row also sees
    values below it that have the same.
    """
    # patterns in values are matched once a row, not once more for the condition
    worth = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
    marked = worth.withColumns({f"_m_{n}": F.when(F.col(f"_v_{n}").isNotNull(), F.struct(F.col(order).alias("at"), F.col(f"_v_{n}").alias("value"))) for n in values}).drop(*[f"_v_{n}" for n in values])
    ends = marked.groupBy(*keys, block).agg(*[F.max(f"_m_{n}").alias(f"_e_{n}") for n in values])
    upto = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, block, *[F.max(f"_e_{n}").over(upto).alias(f"_b_{n}") for n in values])
    here = Window.partitionBy(*keys, block).orderBy(within or order)
    frames = {n: here.rangeBetween(Window.unboundedPreceding, 0) if within else here.rowsBetween(Window.unboundedPreceding, -1 if n in above else 0) for n in values}
    found = with_digests(marked, before, [*keys, block]).withColumns({n: F.coalesce(F.max(f"_m_{n}").over(frames[n]), F.col(f"_b_{n}"))["value"] for n in values})
    return found.drop(*[f"_{p}_{n}" for n in values for p in "mb"])
