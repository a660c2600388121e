"""Media columns against a plain reading of their contract; mixing against SQL and its promises."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from timberline.llm import media_columns, mixing, queries

from ..compare import agree
from . import plain


def test_stored_media_hold_the_texts(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in plain.rows_of(spark, sf)]
    docs = plain.table(spark, rows + [(-r[0], r[1], r[2]) for r in plain.edge_rows()])
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    by_text = {}
    for r in media_columns.text_media(docs).collect():
        raw = texts[r.doc_id]
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), plain.sha(payload), zlib.crc32(payload[-64:])), r.doc_id
        stored = media_columns.pack(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), plain.sha(stored))
        assert by_text.setdefault(raw, r.feature) == r.feature
        assert r.caption == str(r.doc_id)


def test_parts_keep_their_order(spark):
    html = '<h1>T</h1><p>a <b>b</b></p><figure><img src="sha256:' + "0" * 64 + '" alt="x"><figcaption>cap</figcaption></figure><script>no</script>tail<img src="http://e/x.png" title="t"><p>broken <unclosed'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>only text")], "page_id long, html string")
    got = {r.page_id: [(p.position, p.kind, p.text, p.caption) for p in r.parts] for r in media_columns.sequences(pages).collect()}
    assert got[1][:5] == [(0, "text", "T", None), (1, "text", "a b", None), (2, "media", "sha256:" + "0" * 64, "cap"), (3, "text", "tail", None), (4, "media", "http://e/x.png", "t")]
    assert got[2] == got[3] == []
    assert got[4] == [(0, "text", "only text", None)]
    empty = spark.createDataFrame([], f"digest string, {media_columns.FEATURES}")
    rows = media_columns.resolve(media_columns.sequences(pages), empty).collect()
    assert {(r.page_id, r.position, r.caption, r.payload_bytes) for r in rows} == {(1, 2, "cap", None), (1, 4, "t", None)}


def test_pages_of_the_corpus(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in media_columns.sequences(pages).join(pages, "page_id").collect():
        assert [p.position for p in r.parts] == list(range(len(r.parts)))
        assert sum(p.kind == "media" for p in r.parts) == len(re.findall(r"<(?:img|audio|video|source|embed)\b[^>]*\bsrc=", r.html or ""))


def test_mix_agrees_with_sql(spark, sf):
    agree(spark, queries.op10_mixing, queries.oracle_sql()["op10_mixing"], sf)


@pytest.mark.parametrize("which", ["corpus", "edges"])
def test_mix_meets_its_targets(spark, sf, which):
    rows = [(r.doc_id, r.text, r.source) for r in plain.rows_of(spark, sf)] if which == "corpus" else plain.edge_rows()
    docs = plain.table(spark, rows).repartition(3)
    got = mixing.decisions(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.decisions(docs).collect()))
    source = {r[0]: r[2] for r in rows}
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == len(plain.words(dict(x[:2] for x in rows)[r.doc_id]))
        assert r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0
        sizes[s] += r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
        target[s] = r.target
    assert all(r.source_size == sizes[source[r.doc_id]] for r in got)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)
    total = 1.5 * sum(sizes.values())
    assert abs(sum(target.values()) - min(total, 2 * sum(sizes.values()))) < 1e-6 * total
    assert all(target[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    free = [s for s in order if target[s] < 2 * sizes[s] - 1e-6]
    assert len({round(target[s] / weight[s], 3) for s in free}) <= 1


def test_mix_repeats_rows(spark):
    docs = plain.table(spark, plain.edge_rows())
    times = {r.doc_id: r.times for r in mixing.decisions(docs).collect()}
    from collections import Counter

    got = Counter(r.doc_id for r in mixing.mix(docs).collect())
    copies = Counter(r[0] for r in plain.edge_rows())
    assert got == Counter({i: times[i] * copies[i] for i in times if times[i]})


@pytest.mark.parametrize(("rows", "target"), [([(7, "ten words of a row that comes again and again", "a")] * 100, 1500), ([(None, "one two three", "a")] * 9 + [(2, "four five", "b")] * 4, None)])
def test_equal_rows_are_taken_in_part(spark, rows, target):
    """One row's size off the target at most, in the decisions and in the mix."""
    docs = plain.table(spark, rows).repartition(4)
    got = mixing.decisions(docs).collect()
    taken: dict[float, int] = defaultdict(int)
    for r in got:
        taken[r.target] += r.taken
    assert len(got) == len(rows) and all(abs(t - n) <= 10 for t, n in taken.items())
    assert target is None or taken == {float(target): target}
    assert mixing.mix(docs).count() == sum(r.times for r in got)


@pytest.mark.parametrize("weight", [0.1, 0.8, 30.0, "some of each"])
def test_slices_are_even(spark, weight):
    """Whatever the weights, and with a key that many rows share, no slice is large, and slices rise with the key."""
    rows = spark.range(60_000).select(F.lit("s").alias("_source"), (F.col("id") % 40_000).cast("string").alias("_id"), F.lit(5).cast("long").alias("_size"))
    w = F.when(F.col("_id").cast("int") % 3 == 0, 0.01).when(F.col("_id").cast("int") % 3 == 1, 1.0).otherwise(20.0) if isinstance(weight, str) else F.lit(weight)
    rows = rows.withColumn("_key", mixing.sampling_key(F.col("_id"), F.lit(None).cast("string"), w, 1))
    got = mixing.sliced(rows).groupBy("_class", "_slice").agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("all"), F.min("_key").alias("low"), F.max("_key").alias("high")).orderBy("_class", "_slice").collect()
    assert sum(r.n for r in got) == 40_000 and sum(r["all"] for r in got) == 60_000
    assert max(r.n for r in got) <= 1.5 * mixing.SLICE_ROWS
    assert all(a.high < b.low for a, b in zip(got, got[1:], strict=False))


def test_small_slices_give_the_same_mix(spark, sf, monkeypatch):
    docs = plain.table(spark, [(r.doc_id, r.text, r.source) for r in plain.rows_of(spark, sf)])
    whole = sorted(map(tuple, mixing.decisions(docs).collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 2)
    monkeypatch.setattr(mixing, "CLASSES", 1)
    assert sorted(map(tuple, mixing.decisions(docs).collect())) == whole
