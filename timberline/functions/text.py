"""Clean labels: text, finishes, parts, woods, collections, vendors, users, departments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean a missing value.
MISSING = ["nan", "none", "null"]
# Typographic characters and what they become, in the same order.
FANCY, PLAIN = "\u201c\u201d\u2018\u2019\u2013\u2014\u00a0", "\"\"''-- "
# Finishes by their spelling.
FINISHES = {"finished": "finished", "finshed": "finished", "fin": "finished", "fin.": "finished", "unfinished": "unfinished", "unf": "unfinished", "unf.": "unfinished", "glazed": "glazed", "glaze": "glazed"}
# What is no part number, and how item codes look.
JUNK_PART = (
    r"(?i)^(item\s*\#?|description|price|unf|finished|all|none|nan|null|new(\s*product|\s*items?)?|"
    r"new\s+(january|february|march|april|may|june|july|august|september|october|november|december)(\s+\d{4})?)$"
)
ITEM_CODE = r"(?i)^([A-Z]{1,4}-[A-Z0-9][A-Z0-9\-_/.]{1,24}|[A-Z]{2,6}\d{2,}[A-Z0-9\-]*|\d{3,6})$"
# Names of woods.
WOODS = [
    "Brown Soft Maple", "Rustic Brown Maple", "Rustic Hard Maple", "Rustic White Oak", "Rustic Red Oak", "Rustic QSWO", "Rustic Cherry",
    "Rustic Walnut", "Rustic Hickory", "Rustic Maple", "Character White Oak", "Character Hickory", "Character Cherry", "Character Walnut",
    "Character QSWO", "Character Maple", "Plain White Oak", "QS White Oak", "White Qtrsawn", "Quarter Sawn White Oak",
    "Rough Sawn Wormy Maple", "Rough Sawn White Oak", "Rough Sawn Maple", "Wormy Maple", "Soft Maple", "Hard Maple", "Brown Maple",
    "Sap Cherry", "Red Oak", "White Oak", "QSWO", "PSWO", "Cherry", "Hickory", "Walnut", "Maple", "Oak", "Elm", "Ash", "Mahogany", "Pine",
    "Birch", "Alder", "Beech",
]
# Short forms of woods and what they stand for.
WOOD_SHORT = [
    (r"\bbr\.?\s*maple\b", "Brown Maple"), (r"\bhd\.?\s*maple\b", "Hard Maple"), (r"\bru\.?\s*qswo\b", "Rustic QSWO"),
    (r"\bru\.?\s*cherry\b", "Rustic Cherry"), (r"\bru\.?\s*walnut\b", "Rustic Walnut"), (r"\bru\.?\s*hickory\b", "Rustic Hickory"),
    (r"\br\.?\s*walnut\b", "Rustic Walnut"), (r"\bwhite\s*qtrsawn\b", "QS White Oak"), (r"\bqsw[o0]\b", "QSWO"),
    (r"\brustic\s*ch\b", "Rustic Cherry"), (r"\brrs\.?\s*maple\b", "Rough Sawn Maple"),
]
# Labels that name a colour, a cloth or a grade rather than a wood, and those that name a wood.
SURFACE = r"(?i)color|leather|premium|standard|woodgrain|poly|fabric|black|bright"
ANY_WOOD = r"(?i)oak|maple|cherry|walnut|hickory|qswo"
# Mattress sizes.
SIZES = {"twin": "Twin", "twinxl": "TwinXL", "full": "Full", "queen": "Queen", "king": "King", "cal king": "Cal King"}
# Words between woods that name none.
FILLERS = ["and", "or", "also", "the", "with", "(", ")"]
# What is no collection, and collections that vendors have where none is named.
SHEET_NAME = r"(?i)^(master(_bk)?|pl\s*to\s*export|pl\s*print|pl\s*with\s*markup|\d{4}\s+hopewood\s+pricelist|wholesale|retail|sheet\d*|footer\s*summary|price|description|read\s*first!?|instructions?)$"
INSTRUCTION = (
    r"(?i)add\s+metal\s+leg|door\s+options?|inset\s+panel|replace\s+glass|adjustable\s+shelf|for\s+matching\s+bar\s+stools|see\s+seating|"
    r"top\s+is\s+inset|two\s+tone|\$50/|markup|subject\s+to\s+change|please\s+note|available\s+in\s+(crypton|leather|fabric)|we\s*carry\s+heartland|^price$|^description$|^options?$"
)
DEFAULT_COLLECTIONS = {"FN Chair": "Seating", "Genuine Oak": "Casegoods"}
CABINET_NAMES = {"gun": "Gun Cabinets", "guns": "Gun Cabinets", "bookcases": "Bookcases", "tvconsoles": "TV Consoles", "tvconsole": "TV Consoles"}
# Builders by spellings of their names, and by what file names hold; the first that fits counts.
VENDORS = {
    "hope wood": "Hope Wood", "hopewood": "Hope Wood", "genuine oak": "Genuine Oak", "millers woodshop": "Millers Woodshop",
    "miller's woodshop": "Millers Woodshop", "millers": "Millers Woodshop", "mws": "Millers Woodshop", "mws 2023": "Millers Woodshop",
    "windy acres furniture": "Windy Acres Furniture", "windy acres": "Windy Acres Furniture", "fn chair": "FN Chair", "fn chairs": "FN Chair",
    "rainbow bedding": "Rainbow Bedding", "rainbow": "Rainbow Bedding", "premier woodcraft": "Premier Woodcraft", "premier": "Premier Woodcraft",
    "charleston forge": "Charleston Forge", "luxhome": "LuxHome", "lux home": "LuxHome", "aj's luxhome": "LuxHome", "ajs luxhome": "LuxHome",
    "aj luxhome": "LuxHome", "patio kraft": "Patio Kraft", "patiokraft": "Patio Kraft", "beaverdam": "Beaverdam", "gvwi": "GVWI",
    "gable valley": "GVWI", "lamb": "LAMB", "j & m woodworking": "J & M Woodworking", "j&m woodworking": "J & M Woodworking",
    "j and m woodworking": "J & M Woodworking", "jmw": "J & M Woodworking",
}
VENDOR_HINTS = [
    (r"(?i)genuine\s*oak", "Genuine Oak"), (r"(?i)millers?\s*woodshop|mws\b", "Millers Woodshop"), (r"(?i)windy\s*acres", "Windy Acres Furniture"),
    (r"(?i)\bfn\s*chairs?\b", "FN Chair"), (r"(?i)rainbow\s*bedding|jan\s*2026\s*wholesale", "Rainbow Bedding"),
    (r"(?i)premier\s*woodcraft|\bpremier\b", "Premier Woodcraft"), (r"(?i)charleston\s*forge", "Charleston Forge"),
    (r"(?i)lux\s*home|luxhome|aj'?s?\s*lux", "LuxHome"), (r"(?i)patio\s*kraft|patiokraft", "Patio Kraft"), (r"(?i)beaverdam", "Beaverdam"),
    (r"(?i)\bgvwi\b|gable\s*valley", "GVWI"), (r"(?i)\blamb\b", "LAMB"),
    (r"(?i)\bjmw\b|j\s*&\s*m\s*woodworking|j\s*and\s*m\s*woodworking", "J & M Woodworking"), (r"(?i)hope\s*wood|hopewood|\bhw_2025\b|\bhw_", "Hope Wood"),
]
# Departments by words of a line; the first that fits counts.
DEPARTMENTS = [
    ("DELIVERY", ["deliver", "freight", "ship"]), ("DINING ROOM", ["chair", "table", "dining", "bench", "stool", "buffet", "hutch"]),
    ("BEDROOM", ["bed", "dresser", "night", "chest", "wardrobe"]), ("LIVING ROOM", ["sofa", "living", "coffee", "end table", "ottoman"]),
    ("CABINETS", ["cabinet", "kitchen"]), ("OFFICE", ["office", "desk"]), ("OUTDOOR", ["outdoor", "poly"]),
]


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for key, null if it has none."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def squeeze(x: Column) -> Column:
    """Runs of white space as one blank, none at either end."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_text(x: Column) -> Column:
    """Plain quotes and dashes, single blanks; null where nothing is left or it spells a missing value."""
    s = squeeze(F.translate(x, FANCY, PLAIN))
    return F.when((s == "") | F.lower(s).isin(MISSING), None).otherwise(s)


def finish(x: Column) -> Column:
    s = F.lower(stripped(x))
    known = lookup(s, FINISHES)
    guess = F.when(s.contains("unf"), "unfinished").when(s.contains("glaz"), "glazed").when(s.contains("fin"), "finished")
    return F.when((s == "") | s.isin(MISSING), None).otherwise(F.coalesce(known, guess))


def part(x: Column) -> Column:
    s = clean_text(x)
    return F.when(~s.rlike(JUNK_PART), s)


def is_item_code(x: Column) -> Column:
    """Whether text looks like an item code; false for null."""
    s = clean_text(x)
    return F.coalesce((F.length(s) <= 36) & ~s.rlike(JUNK_PART) & s.rlike(ITEM_CODE), F.lit(False))


def is_shouted(x: Column) -> Column:
    """Has letters, and none is lower case."""
    return (F.upper(x) == x) & (F.lower(x) != x)


def titled(x: Column) -> Column:
    """Capitals after anything that is no letter, all other letters small."""
    spread = F.regexp_replace(F.lower(x), r"([^\p{L}])(?=\p{L})", "$1\u0001 ")
    return F.regexp_replace(F.initcap(spread), "\u0001 ", "")


def woods(x: Column) -> Column:
    """The woods that a label names, in order, as an array; words that are no wood stand for themselves."""
    s = reduce(lambda c, rule: F.regexp_replace(c, "(?i)" + rule[0], rule[1]), WOOD_SHORT, x)
    s = squeeze(F.regexp_replace(s, r"[,;|/]+", " / "))
    longest = sorted(WOODS, key=lambda w: (-len(w), w))
    name = "|".join(w.replace(" ", r"\s+") for w in longest)
    found = F.regexp_extract_all(s, F.lit(rf"(?i)(?:(?:{name})(?=$|[\s,/\-])|[^\s/]+)"), F.lit(0))
    canon = F.create_map(*[F.lit(y) for w in WOODS for y in (w.lower(), w)])
    named = F.transform(found, lambda w: F.coalesce(canon[F.lower(F.regexp_replace(w, r"\s+", " "))], F.when(is_shouted(w) & (F.length(w) > 1), titled(w)).otherwise(w)))
    return F.filter(named, lambda w: ~F.lower(w).isin(FILLERS) & ~w.rlike(r"^\W+$"))


def species(x: Column) -> Column:
    """A wood, several joined by ` / `, a wood tier, a surface or a size; null for junk."""
    raw = clean_text(x)
    index = F.nullif(F.regexp_extract(raw, r"\((\d+)\)\s*$", 1), F.lit(""))
    base = F.trim(F.regexp_replace(raw, r"\s*\(\d+\)\s*$", ""))
    tier = F.nullif(F.regexp_extract(base, r"(?i)^wood(?:\s*/\s*|\s+)tier(?:\s*/\s*|\s+)0*(\d+)$", 1), F.lit(""))
    junk = base.rlike(r"(?i)^(col_\d+.*|unnamed.*|price|markup|windy\s+acres.*pricelist.*|\d+(\.\d+)?|-)$")
    surface = base.rlike(SURFACE) & ~base.rlike(ANY_WOOD)
    even = (F.lower(base) == base) | is_shouted(base)
    plain = squeeze(F.regexp_replace(F.regexp_replace(base, r"(?i)\(also\s+([^)]+)\)", "$1"), r"\([^)]*\)", " "))
    joined = F.nullif(F.array_join(woods(plain), " / "), F.lit(""))
    joined = F.regexp_replace(F.regexp_replace(joined, r"(?i)\bqswo\b", "QSWO"), r"(?i)\bqs\b", "QS")
    return (
        F.when(raw.isNull() | (base == ""), None)
        .when(base.rlike(r"(?i)^(finished|unfinished|finshed)$"), F.concat(F.lit("Wood Tier "), F.coalesce(index, F.lit("1"))))
        .when(tier.isNotNull(), F.concat(F.lit("Wood Tier "), tier))
        .when(junk, None)
        .when(surface, F.when(even, titled(base)).otherwise(base))
        .otherwise(F.coalesce(lookup(F.lower(base), SIZES), joined))
    )


def is_junk_species(x: Column) -> Column:
    s = stripped(x)
    return F.coalesce(s.rlike(r"(?i)^col_\d+") | s.rlike(r"^\d+(\.\d+)?(\s*\(\d+\))?$") | (s.rlike(r"(?i)pricelist|price list") & (F.length(s) > 20)), F.lit(False))


def collection(x: Column, vendor: Column) -> Column:
    """A collection without sheet names, instructions and finishes; the vendor's own where none is left."""
    default = lookup(vendor, DEFAULT_COLLECTIONS)
    s = stripped(F.regexp_replace(stripped(F.regexp_replace(stripped(x), r"\s*\(\d+\)\s*$", "")), r"(?i),?\s*continued\s*$", ""))
    bad = (s == "") | F.lower(s).isin(MISSING) | s.rlike(SHEET_NAME) | s.rlike(r"(?i)^col_\d+") | s.rlike(INSTRUCTION) | (F.length(s) > 70)
    rest = stripped(F.regexp_replace(s, r"(?i)^mult-?", ""))
    s2 = F.when(s.rlike(r"(?i)^mult"), F.coalesce(lookup(F.regexp_replace(F.lower(rest), " ", ""), CABINET_NAMES), rest)).otherwise(s)
    s3 = stripped(F.regexp_replace(s2, r"(?i)\s*[-–]?\s*(unfinished|finished)\s*$", ""))
    wood = s3.rlike(r"(?i)^(oak|rustic|qswo|walnut|cherry|maple|hickory|elm|br/|chy/)") & ~s3.rlike(r"(?i)collection|series|suite|desk|cabinet|table|bed|chair")
    shown = F.when(is_shouted(s3) & F.length(s3).between(4, 39), titled(s3)).otherwise(s3)
    return F.when(s.isNull() | bad | wood | (s3 == ""), default).otherwise(shown)


def vendor(name: Column, filename: Column | None = None) -> Column:
    """One name per builder.  An explicit name wins; hints in the file's name count where there is none."""
    s = clean_text(name)
    c = F.regexp_replace(s, "_+", " ")
    c = F.regexp_replace(c, r"(?i)\s*(wholesale|retail)?\s*(price\s*list|pricelist|pricebook).*$", "")
    c = F.regexp_replace(c, r"\s+\d{1,2}[-_/]\d{1,2}[-_/]\d{2,4}.*$", "")
    c = F.regexp_replace(c, r"(?i)\s*[-_]?\s*(revised|rep|digital|master).*$", "")
    # the last digits of a longer number are no year
    c = squeeze(F.regexp_replace(c, r"\s*(?<!\d)20\d{2}\s*$", ""))

    def hinted(x: Column) -> Column:
        return F.coalesce(*[F.when(x.rlike(rule), F.lit(canon)) for rule, canon in VENDOR_HINTS])

    own = F.coalesce(lookup(F.lower(s), VENDORS), lookup(F.lower(c), VENDORS), hinted(s), hinted(c), F.nullif(c, F.lit("")), s)
    return own if filename is None else F.coalesce(own, hinted(filename))


def builder_key(x: Column) -> Column:
    """Lower case, & as `and`, all else that is neither letter nor digit as single blanks."""
    s = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "&", "and")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def user_name(display: Column, email: Column) -> Column:
    """The local part of an address, else first.last of a name, else `user`."""
    local = F.regexp_replace(F.lower(F.trim(F.regexp_extract(email, "^([^@]*)@", 1))), "[^a-z0-9._-]+", "")
    name = F.trim(F.coalesce(display, F.lit("")))
    swapped = F.when(name.contains(","), F.concat_ws(" ", F.regexp_extract(name, "^[^,]*,(.*)$", 1), F.regexp_replace(F.regexp_extract(name, "^([^,]*),", 1), r"\s+", ""))).otherwise(name)
    words = F.filter(F.transform(F.split(squeeze(swapped), " "), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]+", "")), lambda w: w != "")
    made = F.when(F.size(words) == 0, "user").when(F.size(words) == 1, F.get(words, F.lit(0))).otherwise(F.concat(F.get(words, F.lit(0)), F.lit("."), F.element_at(words, -1)))
    return F.when(email.contains("@") & (local != ""), local).otherwise(made)


def department(collection_: Column, description: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(collection_, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    rules = [F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), F.lit(name)) for name, words in DEPARTMENTS]
    return F.coalesce(*rules, F.lit("OTHER"))


def latin(x: Column) -> Column:
    """Text that a Latin-1 page can show: typographic marks made plain, all beyond as ?."""
    s = F.regexp_replace(F.translate(x, FANCY + "×", PLAIN + "x"), "…", "...")
    return F.regexp_replace(s, r"[^\x00-ÿ]", "?")
