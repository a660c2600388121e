"""Rows that share a key: pairs of neighbours, tiles in which all rows of a key meet, and bounded filters of ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import apart

#: Bits of a filter of ids as powers of two: the least and the most; the largest takes 16 MB, and its table has 1/64 as many rows.
FILTER_BITS = (20, 27)
#: Rows of a key on a side of a tile.
SIDE = 1000


def neighbours(key: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of equal key: each row with the `reach` rows before it."""
    for k in range(1, min(reach, len(key) - 1) + 1):
        right = np.flatnonzero(key[k:] == key[:-k]) + k
        yield right - k, right


def overlapping(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[tuple[int, pa.Table]]:
    """(old, table): each batch, led by the `old` rows (`reach` at most) that come before it."""
    last: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            old = last.num_rows if last is not None else 0
            table = pa.concat_tables([last, table]).combine_chunks() if last is not None else table
            yield old, table
            last = table.slice(max(0, table.num_rows - reach))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal first column, from batches sorted by it; for keys whose rows are bounded, as those of tiles()."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < 50_000:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).to_numpy()
        other = np.flatnonzero(key != key[-1])
        if len(other):
            cut = int(other[-1]) + 1
            yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tiles(rows: DataFrame, key: str, item: str, group: str) -> DataFrame:
    """(tile long, seeks, *columns of rows): every two rows of one key but of different groups meet in a tile, where one of them seeks and the other doesn't.

    Only the keys that hold several groups have tiles.  Of two rows of
    different groups one at least is not in the key's largest group, so only
    such rows seek.  A key's rows are dealt to ceil(rows / SIDE) blocks and
    its seekers to ceil(seekers / SIDE) more, so a tile has SIDE rows on each
    side on average, however many rows the key has.
    """
    spread = rows.groupBy(key).agg(F.min(group).alias("_low"), F.max(group).alias("_high")).filter("_low < _high").select(key)
    mixed = rows.join(apart(spread, key), key)
    by_group = mixed.groupBy(key, group).agg(F.count(F.lit(1)).alias("_n"))
    shape = by_group.groupBy(key).agg(F.max(F.struct("_n", group)).alias("_top"), F.sum("_n").alias("_all"))
    shape = shape.select(key, F.col(f"_top.{group}").alias("_largest"), F.ceil(F.col("_all") / SIDE).alias("_blocks"), F.ceil((F.col("_all") - F.col("_top._n")) / SIDE).alias("_parts"))
    dealt = mixed.join(apart(shape, key), key)
    block, part = F.pmod(F.xxhash64(item), F.col("_blocks")), F.pmod(F.xxhash64(item, F.lit("part")), F.col("_parts"))
    tile = F.xxhash64(key, "_block", "_part").alias("tile")
    stay = dealt.withColumn("_block", block).withColumn("_part", F.explode(F.expr("sequence(0L, _parts - 1)")))
    seek = dealt.filter(F.col(group) != F.col("_largest")).withColumn("_part", part).withColumn("_block", F.explode(F.expr("sequence(0L, _blocks - 1)")))
    return stay.select(tile, F.lit(False).alias("seeks"), *rows.columns).union(seek.select(tile, F.lit(True).alias("seeks"), *rows.columns))


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bits set at the hashes of a long column, some sixteen a distinct id up to the largest size; fit to be broadcast."""
    n = ids.agg(F.approx_count_distinct(column)).first()[0]
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, n))), *FILTER_BITS))
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    rows = ids.select((slot / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False only for ids that the filter does not hold."""
    at = ids.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
