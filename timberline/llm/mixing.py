"""Operator 10: mixing sources to target weights, with DataFrame functions only.

Every row gets an Efraimidis-Spirakis key -ln(u) / w, where u is drawn from a
digest of its id and w is its quality weight (the nearer its words are to six
characters and the fewer of its characters are marks and digits, the higher).  Whole epochs of a source come
first; what is left of its target is filled with rows in the order of their
keys, up to the row whose middle lies beyond the rest.

A source may hold any share of all rows, so its prefix sum has three levels:
rows fall into classes of the key's logarithm, a class with many rows is cut
evenly into slices, and sums are accumulated over classes, over the slices of
a class and over the rows of a slice.  Classes are counted first, so slices
have some SLICE_ROWS rows at most whatever the weights are.  The outcome is one
row per source (epochs, last key and id taken), so texts are never moved.

Defined results: null and empty texts have size 0 and are taken with 0 words;
a null source is a source of its own, after all others; where the cut falls
among rows of equal id, key and size, as many of them are taken as the target
asks for, which ones is open; a null id is drawn by its text; an empty table
gives an empty result.  One row a source passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .durable import written
from .rows import put_away, taken_out

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of all targets over words of all sources; a source's target over its size at most.
SHARE, MOST = 1.5, 2.0
#: Rows of a slice of the key's range, on average, where a class of keys has more.
SLICE_ROWS = 2000
#: Classes of keys for each doubling of the key; some 60 doublings occur.
CLASSES = 64
#: Up to so many classes, of all sources, their counts are broadcast (under 16 MB).
BROADCAST_CLASSES = 400_000
#: Up to so many sources, the table of sources is broadcast (under 1 MB).
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(size: Column, chars: Column, marks: Column) -> Column:
    """Between 0.1 and 1; marks: characters that are neither letters nor blanks."""
    length = 1.0 / (1.0 + F.abs(chars / size.cast("double") - 6.0) / 6.0)
    return F.when(size > 0, F.greatest(F.lit(0.1), length * (1.0 - F.least(F.lit(0.8), 3.0 * marks / chars)))).otherwise(F.lit(0.1))


def sampling_key(id_: Column, text: Column, weight: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.coalesce(id_.cast("string"), F.md5(text.cast("binary")), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, weight: Column | None) -> DataFrame:
    """docs with _size and _key; weight: a quality weight above 0, if it is not to be taken from the text."""
    out = docs.withColumn("_size", word_count(F.col(text_col)))
    if weight is None:
        marks = F.coalesce(F.regexp_count(text_col, F.lit(r"[!-@\[-`{-~]")), F.lit(0))
        weight = quality_weight(F.col("_size"), F.coalesce(F.length(text_col), F.lit(0)), marks)
    return out.withColumn("_key", sampling_key(F.col(id_col), F.col(text_col), weight, seed))


def targets(rows: DataFrame, source_col: str) -> DataFrame:
    """One row per source: size, target, whole epochs and the rest that is left of the target."""
    by = rows.groupBy(F.col(source_col).alias("_source")).agg(F.sum("_size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("_weight", weight.cast("double")).withColumn("_cap", MOST * F.col("source_size"))
    # the level of a target a unit of weight: sources are filled in the order of cap / weight
    order = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_source").asc_nulls_last())
    full = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(1))
    by = by.withColumn("_level", (F.lit(SHARE) * F.sum("source_size").over(every) - full) / open_weight)
    by = by.withColumn("target", F.least(F.col("_cap"), F.max("_level").over(every) * F.col("_weight")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    by = by.withColumn("epochs", epochs).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    return by.select("_source", "source_size", "target", "epochs", "_rest")


def _sources(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def sliced(rows: DataFrame) -> DataFrame:
    """Rows (_source, _key, ...) once each, with _n of how many are equal, their class of keys and their slice in it; (class, slice) rise with the key."""
    # a key that rows share is one row here, so no slice grows with repeated rows
    rows = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")))
    place = F.log2("_key") * CLASSES
    rows = rows.withColumn("_class", F.floor(place)).withColumn("_part", place - F.col("_class"))
    counts = written(rows.groupBy(F.col("_source").alias("_s"), F.col("_class").alias("_c")).agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).alias("_slices")))
    if counts.count() <= BROADCAST_CLASSES:
        counts = F.broadcast(counts)
    rows = rows.join(counts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
    return rows.withColumn("_slice", F.least(F.col("_slices") - 1, F.floor(F.col("_part") * F.col("_slices")))).drop("_s", "_c", "_slices", "_part")


def plan(light: DataFrame) -> DataFrame:
    """One row per source: source_size, target, epochs, and of the last rows that are taken once more _cut (key, id, size), how many of such rows are taken, and whether that is all.

    light: (_id, _from, _size, _key) of all rows.
    """
    by = written(targets(light, "_from"))
    rows = light.join(_sources(by), F.col("_from").eqNullSafe(F.col("_source")))
    rows = sliced(rows.filter("_rest > 0").select("_id", "_source", "_size", "_key", "_rest"))
    words = F.col("_size") * F.col("_n")
    sums = rows.groupBy("_source", "_class", "_slice").agg(F.sum(words).alias("_sum"))
    in_class = F.sum("_sum").over(Window.partitionBy("_source", "_class").orderBy("_slice")) - F.col("_sum")
    classes = sums.groupBy(F.col("_source").alias("_s"), F.col("_class").alias("_c")).agg(F.sum("_sum").alias("_of_class"))
    classes = classes.withColumn("_upto", F.sum("_of_class").over(Window.partitionBy("_s").orderBy("_c")) - F.col("_of_class"))
    sums = sums.withColumn("_in_class", in_class).join(classes, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
    sums = sums.select(F.col("_source").alias("_t"), F.col("_class").alias("_k"), F.col("_slice").alias("_m"), (F.col("_upto") + F.col("_in_class")).alias("_before"))
    within = F.sum(words).over(Window.partitionBy("_source", "_class", "_slice").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)) - words
    rows = rows.withColumn("_within", within).join(sums, F.col("_source").eqNullSafe(F.col("_t")) & (F.col("_class") == F.col("_k")) & (F.col("_slice") == F.col("_m")))
    # the k-th of equal rows is taken if its middle lies within the rest
    left = F.col("_rest") - F.col("_before") - F.col("_within")
    some = F.when(F.col("_size") == 0, F.when(left >= 0, F.col("_n")).otherwise(0)).otherwise(F.least(F.col("_n"), F.floor(left / F.greatest(F.col("_size"), F.lit(1)) + 0.5)))
    taken = rows.withColumn("_some", some).filter("_some > 0")
    cuts = taken.groupBy(F.col("_source").alias("_s")).agg(F.max(F.struct("_key", "_id", "_size", "_some", "_n")).alias("_last"))
    out = by.join(cuts, F.col("_source").eqNullSafe(F.col("_s")), "left")
    cut = F.when(F.col("_last").isNotNull(), F.struct("_last._key", "_last._id", "_last._size"))
    return written(out.select("_source", "source_size", "target", "epochs", cut.alias("_cut"), F.col("_last._some").alias("_cut_some"), (F.col("_last._some") >= F.col("_last._n")).alias("_cut_whole")))


def _timed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (_id, _from, _size, _key and more) with their source's plan and how many times each is taken."""
    out = rows.join(_sources(table), F.col("_from").eqNullSafe(F.col("_source")))
    place = F.struct("_key", "_id", "_size")
    last, whole = F.coalesce(place.eqNullSafe(F.col("_cut")), F.lit(False)), F.coalesce("_cut_whole", F.lit(True))
    more = F.coalesce(place < F.col("_cut"), F.lit(False)) | last
    if table.filter("not _cut_whole").isEmpty():
        return out.withColumn("times", F.col("epochs") + more.cast("long"))
    # of the rows of a cut that are taken in part, the first so many in the order in which they are written
    part = written(out.filter(last & ~whole).withColumn("_n", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_n", 33)))
    counts = part.groupBy(F.col("_source").alias("_s"), F.col("_task").alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("_s").orderBy("_t")) - F.col("_c"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_source", "_task").orderBy("_n"))
    part = part.join(counts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t"))).withColumn("times", F.col("epochs") + (rank <= F.col("_cut_some")).cast("long"))
    rest = out.filter(~last | whole).withColumn("times", F.col("epochs") + more.cast("long"))
    return rest.union(part.select(*rest.columns))


def _light(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, weight: Column | None) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(source_col).alias("_from"), *([] if weight is None else [weight.alias("_weight")]))
    return written(sized(rows, seed, "_id", "_text", None if weight is None else F.col("_weight")).select("_id", "_from", "_size", "_key"))


def decisions(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """(id, size, source_size, target, times, taken) of every row; taken: size * times words; weight: a column of docs instead of the text's own quality."""
    light = _light(docs, seed, id_col, text_col, source_col, weight)
    rows = _timed(light, plan(light))
    return rows.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "times", (F.col("_size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; same columns."""
    table = plan(_light(docs, seed, id_col, text_col, source_col, weight))
    rows = put_away(docs, F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(source_col).alias("_from"), *([] if weight is None else [weight.alias("_weight")]))
    rows = _timed(sized(rows, seed, "_id", "_text", None if weight is None else F.col("_weight")), table)
    return rows.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select(*taken_out(docs.columns))


def sql(seed: int = 17) -> str:
    """The decisions on `documents` as DuckDB SQL."""
    return f"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    coalesce(length(text), 0) as chars,
    coalesce(len(regexp_extract_all(text, '[!-@\\[-`{{-~]')), 0) as marks,
    (cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':{seed}'), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0 as u
  from documents),
k as (
  select *, -ln(u) / (case when size > 0 then greatest(0.1::double,
      1.0::double / (1.0::double + abs(chars / cast(size as double) - 6.0::double) / 6.0::double) * (1.0::double - least(0.8::double, 3.0::double * marks / chars))) else 0.1 end) as key from d),
s as (select source, cast(sum(size) as bigint) as source_size from k group by source),
w as (
  select *, cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight, 2.0::double * source_size as cap from s),
l as (
  select *, (1.5::double * cast(sum(source_size) over () as double)
    - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
t as (select *, least(cap, max(level) over () * weight) as target from l),
e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
c as (
  select k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    sum(k.size) over (partition by k.source order by k.key, k.doc_id rows unbounded preceding) as upto
  from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target,
  cast(epochs + case when rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end as bigint) as times,
  cast(size * (epochs + case when rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end) as bigint) as taken
from c"""
