"""Boolean search over catalog rows, with filters, ranking and a limit.

A query is read by recursive descent to a tree of words, phrases, and, or, not.
Missing operands and unbalanced parentheses are ignored.  A term matches where
any searched field or price holds it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import SEARCHED

LIMIT = 150
_TOKEN = re.compile(r"""\s+|(?P<open>\()|(?P<close>\))|(?P<or>[|∨])|(?P<not>(?:(?<=[\s()])|^)-(?=\S))|"(?P<double>[^"]*)"?|'(?P<single>[^']*)'?|(?P<word>[^\s()|"']+)""")


def tokens(query: str) -> list[tuple[str, str]]:
    """(kind, text) pairs; kinds: term, and, or, not, open, close."""
    out: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(query.strip()):
        kind, text = m.lastgroup, m.group(m.lastgroup) if m.lastgroup else ""
        if kind in ("double", "single"):
            out.append(("term", text.strip()))
        elif kind == "word":
            out.append((text.lower(), text) if text.upper() in ("AND", "OR", "NOT") else ("term", text))
        elif kind:
            out.append((kind, text))
    return out


@dataclass
class Query:
    """A parsed query: the tree (None if it has no term) and its terms in order."""

    tree: tuple | None
    terms: list[str] = field(default_factory=list)


def parse(query: str) -> Query:
    items = tokens(query)
    at = 0

    def peek() -> str:
        return items[at][0] if at < len(items) else ""

    def either(depth: int) -> tuple | None:
        nonlocal at
        left = every(depth)
        while peek() == "or":
            at += 1
            right = every(depth)
            left = ("or", left, right) if left and right else left or right
        return left

    def every(depth: int) -> tuple | None:
        nonlocal at
        left = single(depth)
        while peek() in ("and", "term", "not", "open") or (peek() == "close" and not depth):
            if peek() in ("and", "close"):
                at += 1
            right = single(depth)
            left = ("and", left, right) if left and right else left or right
        return left

    def single(depth: int) -> tuple | None:
        nonlocal at
        kind = peek()
        if kind == "not":
            at += 1
            inner = single(depth)
            return ("not", inner) if inner else None
        if kind == "open":
            at += 1
            inner = either(depth + 1)
            at += peek() == "close"
            return inner
        if kind == "term":
            at += 1
            return ("term", items[at - 1][1])
        return None

    tree = None
    while at < len(items):
        before, more = at, either(0)
        tree = ("and", tree, more) if tree and more else tree or more
        at += at == before  # an operator without operands
    return Query(tree, [text for kind, text in items if kind == "term"])


def price_text(price: Column) -> Column:
    """A price as people write it, without an exponent: 1250.0, 12.5."""
    plain = F.regexp_replace(price.cast("decimal(20,4)").cast("string"), "0+$", "")
    return F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)


def holds(term: str) -> Column:
    """Whether any searched field or price holds the term; never null."""
    t = term.strip().lower()
    if not t:
        return F.lit(True)
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in SEARCHED]
    # prices have digits, a point and a sign, so other terms need not look at them
    if re.fullmatch(r"[-.0-9]+", t):
        fields += [F.coalesce(price_text(F.col(c)), F.lit("")) for c in ("base_price", "adjusted_price")]
    return reduce(lambda a, b: a | b, [f.contains(t) for f in fields])


def condition(tree: tuple) -> Column:
    kind = tree[0]
    if kind == "term":
        return holds(tree[1])
    if kind == "not":
        return ~condition(tree[1])
    left, right = condition(tree[1]), condition(tree[2])
    return left & right if kind == "and" else left | right


def named(value: str | None) -> bool:
    return bool(value) and value != "All"


def has_species(wood: str) -> Column:
    """The label itself, or one of the woods that ` / ` joins, in any case."""
    label = F.trim(F.coalesce("species", F.lit("")))
    atoms = F.transform(F.split(label, " / "), lambda w: F.lower(w))
    return (label == wood.strip()) | ((F.size(atoms) > 1) & F.array_contains(atoms, wood.strip().lower()))


def filtered(rows: DataFrame, collection: str | None = None, vendor: str | None = None, finish: str | None = None, species: str | None = None, option: str | None = None) -> DataFrame:
    """Rows that pass all filters that are set; charges are hidden unless an option is asked for."""
    option = option.strip() if named(option) else None
    if not option:
        rows = rows.filter(F.lower(F.coalesce("line_kind", F.lit("item"))) != "addon")
    if named(collection):
        rows = rows.filter(F.col("collection") == collection)
    if named(vendor):
        rows = rows.filter(F.col("vendor") == vendor)
    if finish and finish.lower() in ("finished", "unfinished", "glazed"):
        rows = rows.filter(F.col("finish_state") == finish.lower())
    if named(species):
        rows = rows.filter(has_species(species))
    if option:
        rows = rows.filter((F.trim(F.coalesce("option_key", F.lit(""))) == option) | (F.trim(F.coalesce("species", F.lit(""))) == option))
    return rows


def relevance(term: str) -> list[Column]:
    """Order of search results for a ranking term."""
    t = term.lower()
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("part_number", "description", "collection", "species", "finish_state")}
    p = F.trim(low["part_number"])
    rank = F.when(p == t, 0).when(p.startswith(t), 1).when(p.contains(t), 2)
    for k, c in enumerate(("description", "collection", "species"), 3):
        rank = rank.when(low[c].contains(t), k)
    finish = F.when(low["finish_state"] == "finished", 0).when(low["finish_state"] == "unfinished", 1).otherwise(2)
    cover = low["part_number"].endswith("-dc") | low["description"].contains("dust cover")
    return [rank.otherwise(6).asc(), finish.asc(), cover.cast("int").asc(), F.length(F.coalesce("part_number", F.lit(""))).asc()]


BROWSE = ["vendor", "collection", "part_number", "species_tier", "description", "id"]


def search(rows: DataFrame, query: str = "", limit: int = LIMIT, **filters: str | None) -> DataFrame:
    """The best `limit` rows for a query; a query without a term finds nothing, an empty one everything."""
    found, parsed = filtered(rows, **filters), parse(query)
    if query.strip():
        found = found.filter(condition(parsed.tree) if parsed.tree else F.lit(False))
    order = [F.col(c).asc_nulls_first() for c in BROWSE]
    term = max(parsed.terms, key=len, default="").lower()
    return found.orderBy(*(relevance(term) if term else []), *order).limit(limit)


def guarded(rows: DataFrame, query: str = "", limit: int = LIMIT, **filters: str | None) -> DataFrame:
    """search(), but nothing where neither words nor a vendor are asked for."""
    if not query.strip() and not named(filters.get("vendor")):
        return rows.limit(0)
    return search(rows, query, limit, **filters)
