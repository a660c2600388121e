"""Lines of price lists: blocks against a machine that reads line by line, and what each reader makes of odd input."""

from __future__ import annotations

import random
import re

import pytest

from timberline.operators import pages, running

LINES = "file string, page int, line_no int, line string"


def walk(lines: list[tuple[int, str]]) -> list[tuple]:
    """(part, description, species, collection, price) of the items of one file, a line at a time."""
    found, section, item, solid, held, last_page = [], None, None, False, [], None

    def close(prices):
        code = re.match(pages.CODE, item)
        part, told = (code[1], code[2].strip()) if code else (None, item)
        for k, price in enumerate(prices):
            if price is not None:
                label = None if len(prices) == 1 else pages.PRICE_LABELS[k] if len(prices) <= 8 else f"Species {k + 1}"
                found.append((part, told + " — Solid" * solid, label, section, price))

    def value(token):
        if re.fullmatch("(?i)N/?A", token):
            return None
        hit = re.search(pages.MONEY, token if token.startswith("$") else "$" + token)
        return float(hit[1].replace(",", "")) if hit else None

    for page, raw in [*lines, (10**6, "Walnut")]:
        line = " ".join(raw.split())
        if not line or re.search(pages.SKIP, line) or re.fullmatch(r"\d{1,3}", line):
            continue
        price = re.match(pages.PRICE_LINE, line)
        if held and (not price or page != last_page):
            close(held)
            item, held = None, []
        last_page = page
        woods = any(w in line.lower() for w in pages.WOOD_HINTS) and len(line) < 80
        if price:
            if item:
                held.append(value(line))
        elif line.lower() == "solid" and item:
            solid = True
        elif re.search(pages.MONEY, line):
            if item:
                close([value(t) for t in re.findall(pages.PRICE_TOKEN, line)])
            item = None
        elif not re.search(r"\d", line) and 3 <= len(line) <= 55 and not woods and (re.search(pages.BLOCK_SECTION, line) or (line[0].isupper() and " " in line and len(line.split()) <= 5)):
            section, item = line, None
        elif not woods and line.lower() not in pages.COLUMN_HEADS:
            item, solid = line, False
    return found


def got(frame) -> list[tuple]:
    return sorted(((r.file, r.part_number, r.description, r.species, r.collection, r.base_price) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_equal_a_line_by_line_reading(spark, seed):
    rng = random.Random(seed)
    stock = ["5885 Albany chair x1", "SU-BT10 stool x", "armless", "Solid", "solid", "$499", "$1,250.00", "2,000", "N/A", "na", "$10 N/A $12", "$1 $2 $3 $4 $5 $6 $7 $8 $9", "Oak Tables", "Big New Look", "Red Oak", "Leaves", "7", "", " \t ", "Page 4", "$", "$,5 x", ","]
    rows, want = [], []
    for f in range(60):
        lines = [(1 + k // rng.choice([3, 7]), rng.choice(stock)) for k in range(rng.randrange(60))]
        lines.sort(key=lambda x: x[0])
        rows += [(f"f{f}", page, k, line) for k, (page, line) in enumerate(lines)]
        want += [(f"f{f}", *x) for x in walk(lines)]
    assert len(want) > 300
    assert got(pages.item_blocks(spark.createDataFrame(rows, LINES))) == sorted(want, key=repr)


@pytest.mark.parametrize("pages_of_a_block", [1, 2, 5])
def test_blocks_of_pages_change_nothing(spark, pages_of_a_block, monkeypatch):
    rng = random.Random(pages_of_a_block)
    stock = ["5885 Albany chair", "SU-BT10 stool", "Solid", "$499", "2,000", "N/A", "$10 N/A $12", "$1 $2", "Oak Tables", "Oak Collection", "Red Oak", "chair $5", "AB-1", "Leaves"]
    lines = {f: sorted((rng.randrange(1, 30), k, rng.choice(stock)) for k in range(150)) for f in range(12)}
    # a file that sets nothing for many pages, and one that begins with prices
    lines |= {12: [(1, 0, "5885 Albany chair")] + [(p, 0, "$7") for p in range(2, 20)], 13: [(p, 0, "Solid" if p % 3 else "$8") for p in range(1, 20)]}
    rows = spark.createDataFrame([(f"f{f}", *x) for f, all_ in lines.items() for x in all_], LINES)
    few = {name: sorted(map(tuple, reader(rows).collect()), key=repr) for name, (reader, _) in pages.READERS.items()}
    monkeypatch.setattr(pages, "PAGES", pages_of_a_block)
    assert {name: sorted(map(tuple, reader(rows, 3).collect()), key=repr) for name, (reader, _) in pages.READERS.items()} == few
    want = sorted(((f"f{f}", *x) for f, all_ in lines.items() for x in walk([(p, line) for p, _, line in all_])), key=repr)
    assert got(pages.item_blocks(rows, 3)) == want


def test_an_item_may_stand_on_the_page_before_its_prices(spark):
    rows = [("a", 1, 0, "Chairs"), ("a", 1, 1, "5885 Albany"), ("a", 2, 0, "$499"), ("a", 2, 1, "N/A"), ("a", 3, 0, "$511")]
    assert got(pages.item_blocks(spark.createDataFrame(rows, LINES))) == [("a", "5885", "Albany", "Brown Maple / Red Oak", "Chairs", 499.0)]


def test_best_reading_is_that_with_most_rows(spark):
    inline = [("a", 1, k, f"{1000 + k} chair ${k + 1}.00") for k in range(6)]
    blocks = [("b", 1, 2 * k + j, x) for k in range(6) for j, x in enumerate((f"{1000 + k} chair", "$20"))]
    few = [("c", 1, 0, "1000 chair $5")]
    tables = [("c", 1, r, c, x) for r, row in enumerate([("Item", "Price"), ("x", "$1"), ("y", "$2"), ("z", "3")]) for c, x in enumerate(row)]
    rows, ranks = pages.readings(spark.createDataFrame(inline + blocks + few, LINES), spark.createDataFrame(tables, "file string, table int, row int, col int, text string"))
    assert {(r.file, r.reader, r.n) for r in ranks.collect() if r["rank"] == 1} == {("a", "inline_prices", 6), ("b", "item_blocks", 6), ("c", "tables", 3)}
    best = pages.best_reading(spark.createDataFrame(inline + blocks + few, LINES)).collect()
    assert {(r.file, r.reader) for r in best} == {("a", "inline_prices"), ("b", "item_blocks")} and len(best) == 12


def test_tables_of_many_blocks_score_as_whole_ones(spark, monkeypatch):
    monkeypatch.setattr(running, "BLOCK_VALUES", 3)
    rng = random.Random(3)
    stock = ["$5", "1,200", " ", "", None, "call", "7.5", "Item"]
    rows = [(f"f{t % 3}", t, r, c, rng.choice(stock)) for t in range(12) for r in rng.sample(range(200), 5 * t + 1) for c in range(3)]
    want = {}
    for file, t in {x[:2] for x in rows}:
        cells = [(r, x.strip()) for f, u, r, _, x in rows if (f, u) == (file, t) and x and x.strip()]
        first = min(x[2] for x in rows if x[:2] == (file, t))
        header = sum(r == first for r, _ in cells) >= 2
        kept = sorted({r for r, _ in cells if not header or r > first})
        score = sum(r in kept[:40] and bool(re.search(pages.MONEY, x) or re.search(pages.NUMBER_CELL, x.replace(",", ""))) for r, x in cells)
        if len(kept) >= 2:
            want[file, t] = (header, len(kept), score)
    found = pages.table_scores(spark.createDataFrame(rows, "file string, table int, row int, col int, text string"), parts=3).collect()
    assert {(x.file, x.table): (x.header, x.rows, x.score) for x in found} == want and len(want) > 8


def test_no_lines(spark):
    empty = spark.createDataFrame([], LINES)
    assert pages.best_reading(empty).count() == 0
    assert pages.item_blocks(spark.createDataFrame([("a", 1, 1, None), ("a", 1, 2, "$4")], LINES)).count() == 0
