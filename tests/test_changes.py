"""Differences, guarded replacements and sessions on small tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from timberline import change_queries, queries
from timberline.functions import text
from timberline.operators import changes, sessions
from timberline.plans.catalog import conform

from .compare import agree

ROW = "id long, vendor string, collection string, part_number string, description string, base_price double, multiplier double, species string, notes string"


def book(spark, rows):
    return conform(spark.createDataFrame(rows, ROW))


def test_nothing_blank_and_zero_are_one(spark):
    old = spark.createDataFrame([(1, "a", None, 1.0), (2, None, "", None), (3, "x", "y", 5.0), (4, "x", None, 1.0), (None, "x", None, 1.0)], "id long, a string, b string, p double")
    new = spark.createDataFrame([(1, "a", "", 1.0 + 1e-12), (2, "", None, 0.0), (3, "X", "y", 5.1), (5, "n", None, 1.0), (None, "x", None, 1.0)], "id long, a string, b string, p double")
    got = sorted(((r.id, r.status, tuple(r.fields)) for r in changes.differences(old, new).collect()), key=repr)
    assert got == sorted([(1, "kept", ()), (2, "kept", ()), (3, "changed", ("a", "p")), (4, "dropped", ()), (5, "added", ()), (None, "dropped", ()), (None, "added", ())], key=repr)


def test_standardised_in_place(spark):
    rows = book(spark, [(1, "MWS", "SHAKER TABLES", "T-1", "Table", 100.0, 2.7, "Oak", None), (2, "Millers Woodshop", "Chairs", "C-1", "Chair", None, 2.7, "Oak", None), (3, "Nobody", "Chairs", "C-2", "Chair", 50.0, 2.7, "Oak", None)])
    settings = spark.createDataFrame([("mws", 2.5), ("Millers Woodshop", 2.6), ("gone", 1.0), ("Nobody", 3.0)], "name string, multiplier double")
    clean, kept, different = changes.standardized_in_place(rows, settings)
    assert sorted((r.id, r.vendor) for r in clean.collect()) == [(1, "Millers Woodshop"), (3, "Nobody")]
    assert sorted(map(tuple, kept.select("name", "multiplier").collect())) == [("Millers Woodshop", 2.6), ("Nobody", 3.0)]
    fields = {r.id: (r.status, set(r.fields)) for r in different.collect()}
    assert fields[2] == ("dropped", set()) and fields[1][0] == "changed" and {"vendor", "collection"} <= fields[1][1]
    assert changes.counts(different).first().asDict() == {"scanned": 3, "kept": 2, "updated": 2, "dropped": 1}


def test_a_small_list_replaces_no_large_catalog(spark):
    old = [(k, v, "c", f"p{k}", "d", 1.0, 2.7, None, None) for k, v in enumerate(["large"] * 700 + ["small"] * 20 + ["other"] * 3)]
    new = [(0, v, "c", f"n{k}", "d", 2.0, 2.7, None, None) for k, v in enumerate(["large"] * 34 + ["small"] * 5 + ["fresh"] * 6 + ["few"] * 4)]
    plan = {r.vendor: (r.existing, r.offered, r.status) for r in changes.replacement_plan(book(spark, old), book(spark, new)).collect()}
    assert plan == {"large": (700, 34, "kept"), "small": (20, 5, "replaced"), "fresh": (0, 6, "replaced"), "few": (0, 4, "too_few")}
    after = changes.guarded_replacement(book(spark, old), book(spark, new))
    counts = {r.vendor: r["n"] for r in after.groupBy("vendor").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"large": 700, "small": 5, "other": 3, "fresh": 6}
    ids = [r.id for r in after.collect()]
    assert len(set(ids)) == len(ids) and min(r.id for r in after.filter("vendor = 'fresh'").collect()) > 722


def test_sessions(spark):
    now = datetime(2024, 5, 2, 12)
    at = F.lit("2024-05-02 12:00:00").cast("timestamp")
    held = spark.createDataFrame([("a", "k1", now - timedelta(hours=1)), ("b", "k2", now - timedelta(hours=24)), ("c", "k3", now - timedelta(hours=25)), ("d", "k4", None), ("e", "k5", now)], "session_id string, batch_key string, saved_at timestamp")
    asked = spark.createDataFrame(
        [(1, "a", "k1", False, False), (2, "b", "k2", True, True), (3, "c", "k3", False, True), (4, "e", "other", False, False), (5, None, "k9", None, True), (6, "a", "k1", True, False)],
        "request_id long, session_id string, batch_key string, force boolean, has_data boolean",
    )
    assert {r.request_id: r.decision for r in sessions.decided(asked, held, at).collect()} == {1: "reuse", 2: "parse", 3: "parse", 4: "refuse", 5: "parse", 6: "refuse"}
    after = {(r.session_id if not r.session_id.startswith("dps_") else "new", r.batch_key) for r in sessions.after(asked, held, at).collect()}
    assert after == {("a", "k1"), ("new", "k2"), ("new", "k3"), ("new", "k9")}
    rows = spark.createDataFrame([("a", "x", 1.0, 2.7), ("c", "y", 1.0, 2.7)], "session_id string, part string, adjusted_price double, multiplier double")
    got = sessions.committed(rows, held, spark.createDataFrame([("a",), ("c",)], "session_id string"), at)
    assert got.columns == ["session_id", "part"] and [r.part for r in got.collect()] == ["x"]


def test_last_digits_of_a_number_are_no_year(spark):
    names = ["Supplier#000002023", "Supplier#000002023 Pricelist 2025.xlsx", "Nobody 2023", "Nobody2024", "MWS 2023 Wholesale Price List"]
    got = [r.v for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k long, n string").select("k", text.vendor(F.col("n")).alias("v")).orderBy("k").collect()]
    assert got == ["Supplier#000002023", "Supplier#000002023", "Nobody", "Nobody", "Millers Woodshop"]


def test_many_suppliers_agree_with_sql(spark, sf, tmp_path):
    """Supplier numbers that end like years: two vendors are never made one."""
    for name in ("lineitem", "part", "supplier"):
        t = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "lineitem":
            t = t.withColumn("l_suppkey", F.col("l_suppkey") + 2000)
        if name == "supplier":
            t = t.withColumn("s_suppkey", F.col("s_suppkey") + 2000).withColumn("s_name", F.format_string("Supplier#%09d", F.col("s_suppkey")))
        t.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{name}.file")
        for left in sorted((tmp_path / name).iterdir()):
            left.unlink()
        (tmp_path / name).rmdir()
        (tmp_path / f"{name}.file").rename(tmp_path / f"{name}.parquet")
    for name in ("resolve_vendor", "standardize_rows"):
        assert agree(spark, queries.QUERIES[name], queries.ORACLES[name], str(tmp_path))


def test_moved_ids_that_the_book_has(spark):
    far = change_queries.MOVED
    rows = [(17, "V", "c", "p", "d", 5.0, 2.7, "Oak", None), (far + 17, "W", "c", "q", "e", 6.0, 2.7, "Elm", None), (34, "V", "c", "r", "d", 5.0, 2.7, "Oak", None)]
    old = book(spark, rows)
    got = sorted((r.id, r.status, ",".join(r.fields)) for r in changes.differences(old, change_queries._later(old)).collect())

    def by_id(k):
        fields = [f for f, on in (("base_price", k % 7 == 0), ("notes", k % 3 and k % 11 == 0)) if on]
        return k, "changed" if fields else "kept", ",".join(fields)

    held = [by_id(far + 17)] * (2 if (far + 17) % 13 else 1)
    assert got == sorted([by_id(17), by_id(34), *held, (far + 34, "added", "")])
