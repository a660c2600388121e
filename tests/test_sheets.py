"""Headers, column pairs and copies among sheets, on small sheets written out."""

from __future__ import annotations

import random

import pytest

from timberline.operators import guesses, sheets

CELLS = "file string, sheet string, row int, col int, text string"


def cells(spark, *grids: tuple[str, str, list[list]]):
    rows = [(f, s, r, c, None if x is None else str(x)) for f, s, grid in grids for r, line in enumerate(grid) for c, x in enumerate(line)]
    return spark.createDataFrame(rows, CELLS)


def names(frame, sheet: str) -> list[str]:
    return [r.name for r in sorted(frame.filter(f"sheet = '{sheet}'").collect(), key=lambda r: r.col)]


@pytest.mark.parametrize("seed", range(3))
def test_assigned_in_turn(spark, seed):
    rng = random.Random(seed)
    pairs = {(k, a, b): round(rng.random(), 1) for k in "xyz" for a in range(8) for b in range(6) if rng.random() < 0.5}
    want = []
    for k in "xyz":
        used: set[int] = set()
        for a in range(8):
            free = sorted((cost, b) for (key, s, b), cost in pairs.items() if key == k and s == a and b not in used)
            if free:
                used.add(free[0][1])
                want.append((k, a, free[0][1], free[0][0]))
    frame = spark.createDataFrame([(*k, c) for k, c in pairs.items()], "sheet string, a int, b int, c double")
    assert sorted(map(tuple, sheets.assigned(frame, ["sheet"], "a", "b", "c").collect())) == sorted(want)


def test_two_woods_at_one_price_take_two_columns(spark):
    grid = [[100 + k, 270 + 2.7 * k, 270 + 2.7 * k, (100 + k) * 1.02, 27 + k] for k in range(6)]
    values = spark.createDataFrame([("s", r, c, str(x)) for r, line in enumerate(grid) for c, x in enumerate(line)], "sheet string, row int, col int, value string")
    woods = spark.createDataFrame([("s", 1), ("s", 2)], "sheet string, col int")
    assert sorted(map(tuple, guesses.wholesale_columns(values, woods, 2.7).collect())) == [("s", 1, 0), ("s", 2, 3)]
    heads = spark.createDataFrame([("s", 0, "Item #"), ("s", 3, "Net")], "sheet string, col int, name string")
    assert sorted(map(tuple, guesses.wholesale_columns(values, woods, 2.7, heads).collect())) == [("s", 1, 3)]
    assert guesses.wholesale_columns(values, woods, 1.1).count() == 0


def test_headers_of_two_rows(spark):
    hopewood = [["Item #", "Description", "Oak", None, "Cherry", None, "Elm", None, "Mark up over", "Oak"], [None, None, "Unfinished", "Finished", "Unfinished", "Finished", "Finished", None, None, "Finished"], ["A1", "Table", 1, 2, 3, 4, 5, None, None, 9]]
    premier = [["Item #", "Brown Maple", "Total", "Walnut", "Walnut"], [None, "Finished", "Finished", "Finished", "Finished"], ["A1", 1, 2, 3, 4]]
    plain = [["Item #", "Oak", "Oak"], ["A1", 100, 200]]
    frame = cells(spark, ("f", "hopewood", hopewood), ("f", "premier", premier), ("f", "plain", plain))
    heads = spark.createDataFrame([("f", s, 0) for s in ("hopewood", "premier", "plain")], "file string, sheet string, header int")
    got, body = sheets.headed(frame, heads)
    # the elm has no unfinished column: it and what follows doesn't count
    assert names(got, "hopewood") == ["Item #", "Description", "Oak | Unfinished", "Oak | Finished", "Cherry | Unfinished", "Cherry | Finished", "skip_Elm | Finished", "skip_7", "skip_8"]
    assert names(got, "premier") == ["Item #", "Brown Maple | Finished", "Total", "Walnut | Finished", "Walnut | Finished (2)"]
    assert names(got, "plain") == ["Item #", "Oak", "Oak (2)"]
    assert {(r.sheet, r.body) for r in body.collect()} == {("hopewood", 1), ("premier", 1), ("plain", 0)}


def test_each_price_once_of_a_file_with_both_twins(spark):
    plain, marked = [["A", 100], ["B", 200], ["C", 300], ["D", 50]], [["A", 250], ["B", 500], ["C", 750], ["D", 125]]
    frame = cells(spark, ("a", "Price List", plain), ("a", "Price List with Markup", marked), ("a", "Mark Up", [["x", 2.5]]), ("b", "Retail", marked), ("b", "Wholesale", plain), ("c", "Retail", marked), ("d", "List mark-up", marked))
    kept = {(r.file, r.sheet) for r in sheets.without_copies(frame).select("file", "sheet").distinct().collect()}
    assert kept == {("a", "Price List"), ("a", "Mark Up"), ("b", "Wholesale"), ("c", "Retail"), ("d", "List mark-up")}
    assert sorted(map(tuple, sheets.twin_ratios(frame).collect())) == [("a", "Price List with Markup", "Price List", 2.5, 4), ("b", "Retail", "Wholesale", 2.5, 4)]


def test_flyers_replace_junk(spark):
    lines = [["Outdoor", None, None, None]] + [[f"Glider {k} seat", 100 + k, f"Rocker {k} seat", 200 + k] for k in range(6)] + [["Swings", None, None, None], ["Swing four", 300, "phone 5", 99]]
    frame = cells(spark, ("f", "aspen", lines))
    flyer = sheets.flyer_rows(frame)
    got = {(r.collection, r.part_number, r.base_price) for r in flyer.collect()}
    assert ("Swings", "Swing four", 300.0) in got and ("Outdoor", "Rocker 5 seat", 205.0) in got and len(got) == 13
    rows = "file string, sheet string, collection string, part_number string, species string, base_price double"
    junk = spark.createDataFrame([("f", "aspen", None, "36 x 48", "col_3", 3.0)] * 4 + [("f", "good", None, "A", "Oak", 12.0)], rows)
    flyers = flyer.withColumn("species", flyer.part_number.substr(1, 0))
    both = sheets.better_readings(junk, flyers, frame.select("file", "sheet").union(junk.select("file", "sheet"))).collect()
    assert {(r.sheet, r.reading) for r in both} == {("aspen", "flyer"), ("good", "matrix")} and len(both) == 14


def test_no_cells(spark):
    empty = spark.createDataFrame([], CELLS)
    assert sheets.flyer_rows(empty).count() == sheets.without_copies(empty).count() == sheets.headed(empty)[0].count() == 0
