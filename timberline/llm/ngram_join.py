"""Operator 8: n-gram Jaccard join by grouped prefixes.

A text's set holds the hashes of its distinct word shingles.  All sets are put
in one global order, common shingles last, so that two similar sets must share
a shingle of their prefixes.  How common a shingle is comes from counts of all
shingles of all texts in a sketch of fixed size; the order is a function of
the shingle alone, so the sketch only decides how fast the join is, never what
it finds.

Texts with equal sets are one class; classes with equal prefixes and sizes are
one group, and only groups meet in the join:

1.  The groups that share a prefix shingle meet with their neighbours in the
    order of sizes.  The first classes of candidate groups, and each group's
    classes with its first, are verified on their full sets, and what is linked
    is united.
2.  Groups are expanded to their classes.  Classes that share a prefix shingle
    but lie in different components meet in full, in tiles of bounded size that
    are dealt over tasks, so no link between different components is missed;
    links inside a component add nothing to it and are not looked for.

Before sets are compared, histograms of the sets tell which pairs can be
similar at all; they bound the intersection from above, so no link is lost.

Defined results: null texts and texts without words have an empty set and link
with nothing; a text of fewer words than a shingle has one shingle of all its
words; repeated rows share a class; ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .batches import blocks, flat
from .buckets import grouped, id_filter, may_hold, neighbours, overlapping, tiles
from .components import apart, components
from .durable import forget, written
from .rows import put_away, taken_out

#: Counters of the sketch, a power of two; the table of classes that is broadcast has as many bytes.
SLOTS = 1 << 18
REACH = 2
#: Bins of the histogram that meets others within a bucket, a power of two.
FOLD = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and how many precede each text."""
    data = _LOWER[data]
    starts, ends, owner = words.spans(data, offsets)
    each = words.Hasher(data)(starts, ends)
    found, at = words.windows(each, owner, n)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(owner))
    of = text[at]
    few = np.flatnonzero((np.diff(owner) > 0) & (np.diff(owner) < n))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = owner[few] + k < owner[few + 1]
            short[has] = words.mix(short[has] + np.uint64(0xA0761D6478BD642F)) + each[owner[few[has]] + k]
        found, of = np.concatenate([found, words.mix(short)]), np.concatenate([of, few])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[keep], of[keep]
    return found, np.searchsorted(of, np.arange(len(offsets)))


def common_classes(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """For each slot of the sketch 0, or the more the further its count is above what chance gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in blocks(offsets):
                found, _ = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                counts += np.bincount((found & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["slot", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    usual = np.median(counts)
    above = (counts - usual) / (6 * np.sqrt(usual + 1))
    return np.where(above < 1, 0, 1 + np.floor(np.log2(np.maximum(above, 1)))).clip(max=60).astype(np.uint8)


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """Sets of this size that overlap enough share one of so many first shingles."""
    return np.where(size > 0, size - -(-size * percent // 100) + 1, 0)


def histograms(found: np.ndarray, owner: np.ndarray) -> list[bytes]:
    """For each set how many of its hashes fall into each of so many bins, four a bin; 255 stands for 255 or more."""
    size = np.diff(owner)
    bins = np.left_shift(1, np.ceil(np.log2(np.maximum(size // 4, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bins)])
    of = np.repeat(np.arange(len(size)), size)
    at = start[of] + ((found >> np.uint64(20)) & (bins[of] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.bincount(at, minlength=start[-1]).clip(max=255).astype(np.uint8).tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), start[1:].tolist(), strict=False)]


def sketches(found: np.ndarray, owner: np.ndarray) -> pa.Array:
    """The same with FOLD bins for every set."""
    of = np.repeat(np.arange(len(owner) - 1), np.diff(owner))
    at = of * FOLD + ((found >> np.uint64(20)) & np.uint64(FOLD - 1)).astype(np.int64)
    raw = np.bincount(at, minlength=FOLD * (len(owner) - 1)).clip(max=255).astype(np.uint8).tobytes()
    return pa.array([raw[k : k + FOLD] for k in range(0, len(raw), FOLD)], pa.binary())


def shared_at_most(x: bytes, y: bytes) -> int:
    """An upper bound of the size of the intersection of two sets with these histograms."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    for v in (a, b):
        v[v == 255] = 1 << 32
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, n).sum(0), b.reshape(-1, n).sum(0)).sum())


def prefixes(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, size, s1, s2, prefix, bins, fold): s1 and s2 digest the whole set, prefix holds its first shingles as little-endian u8, bins and fold its histograms."""
    sent = docs.sparkSession.sparkContext.broadcast(common_classes(docs, n, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets):
                found, owner = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                size = np.diff(owner)
                s1 = words.per_text(words.mix(found + np.uint64(1)), owner)
                s2 = words.per_text(words.mix(found ^ np.uint64(0x5851F42D4C957F2D)), owner)
                of = np.repeat(np.arange(b - a), size)
                order = np.lexsort((found, common[(found & np.uint64(SLOTS - 1)).astype(np.int64)], of))
                ranked = found[order]
                raw, lengths = ranked.astype("<u8").tobytes(), prefix_length(size, percent)
                first = [raw[8 * s : 8 * (s + k)] for s, k in zip(owner[:-1].tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(first, pa.binary()), pa.array(histograms(found, owner), pa.binary()), sketches(found, owner)], ["id", "size", "s1", "s2", "prefix", "bins", "fold"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, size long, s1 long, s2 long, prefix binary, bins binary, fold binary")


def tokens_of(groups: DataFrame, *columns: str) -> DataFrame:
    """(token, *columns), one row for each shingle of a row's prefix; all columns are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(0))
            at = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.tobytes(), "<i8")), *(batch.column(k).take(at) for k in range(1, batch.num_columns))], ["token", *columns])

    return groups.select("prefix", *columns).mapInArrow(run, ", ".join(f"{c} long" for c in ("token", *columns)))


def first_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups that are next to each other, in the order of sizes, among those that share a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for old, table in overlapping(batches, REACH):
            key, size, grp = (table.column(k).to_numpy() for k in range(3))
            for left, right in neighbours(key, REACH):
                near = (100 * size[left] >= percent * size[right]) & (grp[left] != grp[right]) & (right >= old)
                x, y = grp[left[near]], grp[right[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return tokens.repartition("token").sortWithinPartitions("token", "size", "grp").mapInArrow(run, "a long, b long").distinct()


def mixed(tokens: DataFrame) -> DataFrame:
    """(token, class) of the shingles whose classes are not all in one component; tokens: (token, class, component)."""
    spread = tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token")
    return tokens.join(apart(spread, "token"), "token").select("token", "class")


def cross_pairs(rows: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of classes that share a shingle, may be similar by size and sketch and lie in different components.

    They meet in tiles, where the classes that seek find all such partners, or,
    if only the best is asked for, the one whose sketch is nearest.
    rows: (token, size, class, component, fold).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches):
            tile, seeks, size, name, component = (table.column(k).to_numpy() for k in range(5))
            fold = np.frombuffer(flat(table.column(5))[0], np.uint8).reshape(-1, FOLD)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])), len(tile))
            found = [_partners(seeks[s:e], size[s:e], component[s:e], fold[s:e], percent, best) + s for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            pair = np.concatenate([np.zeros((0, 2), np.int64), *found])
            x, y = name[pair[:, 0]], name[pair[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    dealt = tiles(rows, "token", "class", "component").select("tile", "seeks", "size", "class", "component", "fold")
    return dealt.repartition("tile").sortWithinPartitions("tile", "seeks", "size").mapInArrow(run, "a long, b long").distinct()


def _partners(seeks: np.ndarray, size: np.ndarray, component: np.ndarray, fold: np.ndarray, percent: int, best: bool) -> np.ndarray:
    """Index pairs (seeker, partner) of near size, possible sketch and different component; those that don't seek come first, by size."""
    stay, out = int((~seeks).sum()), []
    for k in range(stay, len(size)):
        low, high = np.searchsorted(size[:stay], [-(-size[k] * percent // 100), 100 * size[k] // percent + 1])
        at = np.flatnonzero(component[low:high] != component[k]) + low
        if not len(at):
            continue
        x, y = fold[at], fold[k]
        full = (x == 255) | (y == 255)
        most = np.where(full, np.maximum(x, y), np.minimum(x, y)).sum(1, dtype=np.int64)
        most[full.any(1)] = 1 << 40  # a bin of unknown height bounds nothing
        most = np.minimum(most, np.minimum(size[at], size[k]))
        ok = 100 * most >= percent * (size[at] + size[k] - most)
        at, most = at[ok], most[ok]
        if best and len(at):
            at = at[[int(most.argmax())]]
        out.append(np.stack([np.full(len(at), k), at], 1))
    return np.concatenate([np.zeros((0, 2), np.int64), *out])


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose histograms allow them to be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n, x, y = (batch.column(k).to_pylist() for k in range(2, 6))
            ok = []
            for k in range(batch.num_rows):
                most = min(shared_at_most(x[k], y[k]), m[k], n[k])
                ok.append(100 * most >= percent * (m[k] + n[k] - most))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (classes.select(F.col("s1").alias(c), F.col("size").alias(f"{c}_size"), F.col("bins").alias(f"{c}_bins")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_size", "b_size", "a_bins", "b_bins").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: np.ndarray, n: int, text_col: str) -> DataFrame:
    """(class, set): the sorted shingles of each class that the filter may hold, as little-endian u8."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in blocks(offsets):
                found, owner = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                s1 = words.per_text(words.mix(found + np.uint64(1)), owner).view(np.int64)
                some = np.flatnonzero((np.diff(owner) > 0) & may_hold(sent.value, s1))
                _, first = np.unique(s1[some], return_index=True)
                some = some[first]
                raw = found.astype("<u8").tobytes()
                sets = [raw[8 * s : 8 * e] for s, e in zip(owner[some].tolist(), owner[some + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s1[some]), pa.array(sets, pa.binary())], ["class", "set"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "class long, set binary").dropDuplicates(["class"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("x")), sets.select(F.col("class").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id: the least id reachable by links."""
    rows = written(prefixes(docs, n, percent, id_col, text_col))
    # a class is named by s1, a group by a digest of its prefix and size
    classes = rows.filter("size > 0").groupBy("s1", "s2", "size").agg(F.min("id").alias("least"), F.first("prefix").alias("prefix"), F.first("bins").alias("bins"), F.first("fold").alias("fold"))
    classes = written(classes.withColumn("grp", F.xxhash64("prefix", "size")))
    members = classes.select(F.col("s1").alias("class"), "grp", "size")
    groups = written(classes.groupBy("grp", "size").agg(F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("classes")))
    inner = members.join(groups.filter("classes > 1").select("grp"), "grp")
    star = inner.groupBy("grp").agg(F.min("class").alias("a"))

    heads = classes.groupBy("grp").agg(F.min("s1").alias("head"))

    def expand(pairs: DataFrame) -> DataFrame:
        """Pairs of groups to pairs of their first classes; the others hang on these, or meet one by one in the second step."""
        x, y = heads.select(F.col("grp").alias("a"), F.col("head").alias("ca")), heads.select(F.col("grp").alias("b"), F.col("head").alias("cb"))
        return pairs.join(x, "a").join(y, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = written(possible(pairs, classes, percent))
        wanted = id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
        return written(verified(pairs, full_sets(docs, wanted, n, text_col), percent))

    tokens = tokens_of(groups, "size", "grp")
    inside = inner.join(star, "grp").filter("class != a").select("a", F.col("class").alias("b"))
    links = verify(expand(first_pairs(tokens, percent)).union(inside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    found = written(components(links))
    # what may still join two components: classes take the place of groups; first each meets its best partner, then all

    def now() -> DataFrame:
        named = classes.join(found, classes["s1"] == found["node"], "left")
        return named.select(F.col("s1").alias("class"), "size", F.coalesce("component", "s1").alias("component"), "fold", "prefix")

    open_ = written(mixed(tokens_of(now(), "class", "component")))
    for best in (True, False):
        met = written(open_.join(now(), "class").select("token", "size", "class", "component", "fold"))
        more = verify(cross_pairs(met, percent, best))
        forget(met)
        if not more.isEmpty():
            links, before = links.union(more), found
            found = written(components(links))
            forget(before)
    # names of components become least ids
    tops = classes.join(found, classes["s1"] == found["node"], "left").select("s1", "s2", F.coalesce("component", "s1").alias("component"), "least")
    least = tops.groupBy("component").agg(F.min("least").alias("component_id"))
    named = tops.join(least, "component").select("s1", "s2", "component_id")
    full = rows.filter("size > 0").select("id", "size", "s1", "s2").join(named, ["s1", "s2"]).select("id", "size", "component_id")
    empty = rows.filter("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return full.union(empty).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of docs with the least id of each component, all columns; rows with an empty set stay.

    Rows are told apart by a hash of id and text; of rows equal in both, one stays at most.  Null ids come first.
    """
    number, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rid = F.xxhash64(number, number.isNull(), text)
    rows = docs.select(rid.alias("rid"), number.alias("id"), text.alias("text"))
    found = written(similar_components(rows, n, percent, "rid", "text").filter("n_shingles > 0").groupBy("rid", "component_id").agg(F.count(F.lit(1)).alias("n")))
    first = found.join(rows.select("rid", "id").distinct(), "rid").groupBy("component_id").agg(F.min(F.struct("id", "rid")).getField("rid").alias("first"))
    # rows that go, and rows of which one stays
    other = written(found.join(first, "component_id").filter("rid != first or n > 1").select(F.col("rid").alias("_other"), (F.col("rid") == F.col("first")).alias("_one")))
    all_rows = put_away(docs, rid.alias("_rid"))
    alone = all_rows.join(other, F.col("_rid") == F.col("_other"), "left_anti").select("_row")
    one = all_rows.join(other.filter("_one"), F.col("_rid") == F.col("_other"), "left_semi").groupBy("_rid").agg(F.first("_row").alias("_row")).select("_row")
    return alone.union(one).select(*taken_out(docs.columns))


def sql(n: int = 4, percent: int = 85) -> str:
    """similar_components on `documents` as DuckDB SQL."""
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < {n} then [array_to_string(ws, ' ')]
    else [array_to_string(ws[k:k + {n - 1}], ' ') for k in range(1, len(ws) - {n - 2})] end) as g from w),
c as (select w.doc_id, count(s.g) as size from w left join s on w.doc_id = s.doc_id group by w.doc_id),
o as (select x.doc_id as a, y.doc_id as b, count(*) as both_ from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
l as (
  select o.a, o.b from o join c p on p.doc_id = o.a join c q on q.doc_id = o.b
  where 100 * o.both_ >= {percent} * (p.size + q.size - o.both_)),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
m as (select a, min(b) as b from r group by a)
select c.doc_id, cast(c.size as bigint) as n_shingles, least(c.doc_id, coalesce(m.b, c.doc_id)) as component_id
from c left join m on m.a = c.doc_id"""
