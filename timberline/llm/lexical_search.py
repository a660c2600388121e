"""Operator 11: ranked lexical search over postings.

`index` makes a DataFrame of postings, one row for a term of a document, dealt
out by buckets of terms (a frequent term over several parts of its bucket) and
written in a folder a bucket, so that a search reads the buckets of its terms
alone.  A search joins the items' terms with the postings, scores each match
with integers, sums by item and document and takes the first by row_number.

Frequent terms match almost every document, so the pairs of items and
documents are many more than the postings.  A document's postings are
therefore brought together first, and its pairs are made and summed in one
task, without a shuffle of pairs.  Few pairs leave it: the k-th best sum of an
item's rarest terms alone is a score that its results must reach, which leaves
out no result, nor a tie of the last one.

Defined results: null texts and texts without a term have no postings and
don't count; repeated documents are documents each; items of one id are one
item with the terms of all; an item without terms, or whose terms weigh
nothing, has no rows; equal scores come in the order of the documents' ids,
null first, rows of one id in the order read; null ids are ids; either table
empty gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .batches import blocks, flat
from .buckets import id_filter, may_hold
from .durable import written

# Fixed value: what terms are made of, as a pattern and as a table over bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IN_TERM = np.ones(256, bool)
IN_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets of terms, and parts of a bucket among which its postings are dealt.
BUCKETS, PARTS = 32, 16
#: Matches of an item's rarest terms that are scored first.
FIRST_MATCHES = 2000
#: Up to so many rows of items' terms, or items, are broadcast (some 10 MB); more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _byte_table() -> np.ndarray:
    """The byte that each byte becomes: A-Z lower-cased, what parts terms a blank."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    is_upper = np.zeros(256, bool)
    is_upper[ord("A") : ord("Z") + 1] = True
    out[~(IN_TERM | is_upper)] = 0x20
    return out


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count, start, end) of each different term of each text, and the terms of each text with repeats; starts and ends are in the folded bytes."""
    starts, ends, owner = words.spans(data, offsets)
    hashes = words.Hasher(data)(starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(owner))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    at = order[first]
    return t[first], h[first], count, starts[at], ends[at], np.diff(owner)


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of data as strings."""
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[take])])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, q): how often each item's text holds each of its terms."""
    folded = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    terms = items.select(F.col(id_col).alias("item"), F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item", "term").agg(F.count(F.lit(1)).alias("q"))


def index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, row, id, tf, n, bucket), written: postings of every document.

    row: a number of the document's own; n: its terms with repeats.  Rows
    without a term hold in tf and n how many documents and terms a block of
    documents has.  terms (term): the only terms whose postings are wanted; a
    filter of bounded size leaves out most of the others.
    """
    spark = docs.sparkSession
    wanted = None if terms is None else spark.sparkContext.broadcast(id_filter(_hashed(terms), "h"))
    table = _byte_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else wanted.value
        for batch in batches:
            raw, offsets = flat(batch.column(2))
            for a, b in blocks(offsets):
                data = table[raw[offsets[a] : offsets[b]]]
                text, h, count, starts, ends, n = term_counts(data, offsets[a : b + 1] - offsets[a])
                docs_, terms_ = int((n > 0).sum()), int(n.sum())
                if bits is not None:
                    keep = may_hold(bits, h.view(np.int64))
                    text, count, starts, ends = text[keep], count[keep], starts[keep], ends[keep]
                at = pa.array(a + text)
                yield pa.RecordBatch.from_arrays([_slices(data, starts, ends), batch.column(0).take(at), batch.column(1).take(at), pa.array(count), pa.array(n[text])], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([0]), pa.nulls(1, batch.column(1).type), pa.array([docs_]), pa.array([terms_])], names)

    names = ["term", "row", "id", "tf", "n"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    postings = rows.mapInArrow(run, f"term string, row long, id {rows.schema['id'].dataType.simpleString()}, tf long, n long")
    postings = postings.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(bucket(F.col("term"))))
    return written(postings.repartition("bucket", F.pmod(F.xxhash64("row", "tf", "n"), F.lit(PARTS))), partition_by="bucket")


def _hashed(terms: DataFrame) -> DataFrame:
    """(h): the hashes of terms that index() uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in blocks(offsets):
                part = data[offsets[a] : offsets[b]]
                yield pa.RecordBatch.from_arrays([pa.array(words.Hasher(part)(offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a]).view(np.int64))], ["h"])

    return terms.select("term").mapInArrow(run, "h long")


def _weights(terms: DataFrame, postings: DataFrame) -> tuple[DataFrame, int, int]:
    """(item, term, q, df, weight, bucket) of the items' terms that weigh something, written; documents and terms of the corpus."""
    held = postings.filter("bucket >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    whole = postings.filter("bucket = -1").agg(F.sum("tf"), F.sum("n")).first()
    n_docs, n_terms = whole[0] or 0, whole[1] or 0
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2.0 * F.col("df") + 1)))
    out = terms.join(held, "term").withColumn("weight", weight).filter("weight > 0").withColumn("bucket", bucket(F.col("term")))
    return written(out), n_docs, n_terms


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def match_score(n_docs: int, n_terms: int) -> Column:
    """Of a match of weight 1, in 64-bit integers."""
    m = f"(25L + (75L * n * {n_docs}L) div {max(1, n_terms)}L)"
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {m})")


def search(items: DataFrame, docs: DataFrame, k: int = 10, postings: DataFrame | None = None, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the k highest-scoring documents of each item.

    postings: an index of docs that is there already; else one of the items'
    terms is made.
    """
    terms = written(item_terms(items, item_col, item_text_col))
    if postings is None:
        postings = index(docs, terms, id_col, text_col)
    weights, n_docs, n_terms = _weights(terms, postings)
    # a document's postings come together before they are joined, so that its matches are summed where they arise
    matched = postings.filter("bucket >= 0").withColumn("unit", match_score(n_docs, n_terms)).select("term", "row", "id", "unit", "bucket")
    point = F.sum(F.col("q") * F.col("weight") * F.col("unit")).alias("score")

    # the least frequent terms of each item, until they have enough matches: the k-th sum is one that a result must reach
    rarest = Window.partitionBy("item").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = weights.withColumn("_before", before).filter(F.col("_before") < FIRST_MATCHES).select("item", "term", "bucket", "q", "weight")
    found = _small(written(first)).join(matched, ["term", "bucket"]).groupBy("item", "row").agg(point)
    kth = found.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("_r") == k)
    bound = written(kth.select(F.col("item").alias("_item"), F.col("score").alias("_bound")))

    scores = matched.repartition("row").join(_small(weights.select("item", "term", "bucket", "q", "weight")), ["term", "bucket"]).groupBy("row", "item").agg(F.first("id").alias("id"), point)
    able = scores.join(_small(bound), F.col("item").eqNullSafe(F.col("_item")), "left").filter(F.col("score") >= F.coalesce("_bound", F.lit(1)))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"), "row")
    top = able.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def sql(k: int = 10) -> str:
    """The search of `benchmark` in `documents` as DuckDB SQL."""
    fold = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
with t as (select doc_id, unnest(regexp_extract_all({fold}, '{TERM}')) as term from documents),
p as (select doc_id, term, count(*) as tf from t group by doc_id, term),
d as (select doc_id, cast(sum(tf) as bigint) as n from p group by doc_id),
c as (select count(*) as docs, cast(sum(n) as bigint) as terms from d),
f as (select term, count(*) as df from p group by term),
w as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from f, c),
i as (select item_id, term, count(*) as q from (select item_id, unnest(regexp_extract_all({fold}, '{TERM}')) as term from benchmark) group by item_id, term),
m as (select doc_id, n, 25 + ((75 * n * docs) // terms) as m from d, c),
s as (select item_id, doc_id, cast(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from i join w using (term) join p using (term) join m using (doc_id) group by item_id, doc_id),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= {k}"""
