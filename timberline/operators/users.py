"""Users synchronised from another system: who is updated, who is new, and names that nobody has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .upkeep import matched_users

# Names that stand for nobody, and what a name may hold.
PLACEHOLDER = r"(?i)^commission"
NO_LOCAL, NO_PART = r"[^a-z0-9._-]+", r"[^a-z0-9]+"
NAMELESS, ADMIN = "user", "admin"


def base_name(name: Column, email: Column) -> Column:
    """The local part of an e-mail address, else first and last name as `first.last`; `Last, First` is turned round."""
    local = F.when(email.contains("@"), F.regexp_replace(F.lower(F.trim(F.substring_index(email, "@", 1))), NO_LOCAL, ""))
    name = F.trim(F.coalesce(name, F.lit("")))
    comma = F.instr(name, ",")
    turned = F.when(comma > 0, F.array(name.substr(comma + 1, F.length(name)), name.substr(F.lit(1), comma - 1))).otherwise(F.split(name, r"\s+"))
    parts = F.filter(F.transform(turned, lambda p: F.regexp_replace(F.lower(p), NO_PART, "")), lambda p: p != "")
    made = F.when(F.size(parts) == 0, NAMELESS).when(F.size(parts) == 1, parts[0]).otherwise(F.concat(parts[0], F.lit("."), F.element_at(parts, -1)))
    return F.coalesce(F.nullif(local, F.lit("")), made)


def _numbered(taken: DataFrame) -> DataFrame:
    """(base, n): how each taken name (username) may have come about: n = 1 for the name itself, else a base and a number from 2."""
    k = F.explode(F.sequence(F.lit(0), F.length(F.regexp_extract("name", r"(\d*)$", 1))))
    cut = taken.select(F.lower("username").alias("name")).distinct().select("name", k.alias("k"))
    digits = F.expr("substring(name, length(name) - k + 1, k)")
    rows = cut.select(F.expr("substring(name, 1, length(name) - k)").alias("base"), F.when(F.col("k") == 0, 1).otherwise(F.expr("try_cast(substring(name, length(name) - k + 1, k) as bigint)")).alias("n"), digits.alias("d"), "k")
    return rows.filter("base != '' and (k = 0 or (n >= 2 and d not like '0%'))").select("base", F.col("n").cast("long").alias("n"))


def _next_free(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(seq, base, username): rows (seq, base), in their order, with the first names of their base that are not taken.

    A taken number n that follows f free ones moves all from the (f + 1)-th
    on by one, so the r-th free number is r and how many taken ones have f < r.
    """
    used = _numbered(taken).join(wanted.select("base").distinct(), "base", "left_semi")
    one = Window.partitionBy("base")
    used = used.select("base", (F.col("n") - F.row_number().over(one.orderBy("n"))).alias("place"), F.lit(1).alias("used"), F.lit(None).cast("long").alias("seq"))
    new = wanted.select("base", F.row_number().over(one.orderBy("seq")).cast("long").alias("place"), F.lit(0).alias("used"), F.col("seq").cast("long").alias("seq"))
    moved = F.sum("used").over(one.orderBy("place", "used", "seq").rowsBetween(Window.unboundedPreceding, 0))
    n = F.col("place") + F.col("moved")
    return used.union(new).withColumn("moved", moved).filter("used = 0").select("seq", "base", F.when(n == 1, F.col("base")).otherwise(F.concat("base", n.cast("string"))).alias("username"))


def free_names(wanted: DataFrame, users: DataFrame) -> DataFrame:
    """(seq, username): a name for each row (seq, base) that no user (username) and no other row has; case doesn't count.

    The name is the base, else the base with the first free number from 2.  A
    base with a number of its own may meet another base's name; of such rows
    the first keeps it and the others are named again, in rounds that end,
    since each gives a name to the first of every clash.
    """
    taken, found = users.select("username").filter("username is not null"), None
    while True:
        named = _next_free(wanted, taken).persist()
        clash = Window.partitionBy("username").orderBy("seq")
        named = named.withColumn("rank", F.row_number().over(clash))
        kept, rest = named.filter("rank = 1").select("seq", "username"), named.filter("rank > 1").select("seq", "base")
        found = kept if found is None else found.union(kept)
        if rest.isEmpty():
            return found
        wanted, taken = rest, taken.union(kept.select("username"))


def synchronised(incoming: DataFrame, users: DataFrame, source: str = "synced") -> DataFrame:
    """users (user_id, username, name, display, guid, email, role, active, source) after incoming rows (seq, guid, name, email, role), with `action`: created, updated or null.

    Rows without a name and placeholders are skipped.  A row meets a user by
    guid, else by either name; of rows that meet one user, or that are new and
    have one guid or name, the last counts.  What a row leaves empty stays,
    an admin stays one, and whoever is met is active.  New users get free
    names, and ids above all others in the order of their rows (seq, unique).
    """
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    rows = incoming.select("seq", *[blank(F.col(c)).alias(c) for c in ("guid", "name", "email", "role")]).filter(F.col("name").isNotNull() & ~F.col("name").rlike(PLACEHOLDER))
    rows = matched_users(rows, users)
    last = lambda rows, *keys: rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "seq").alias("_r")).select("_r.*")
    met = last(rows.filter("user_id is not null"), "user_id").select(F.col("user_id"), *[F.col(c).alias(f"_{c}") for c in ("guid", "name", "email", "role")])
    out = users.join(met, "user_id", "left")
    hit = F.col("_name").isNotNull()
    role = F.when(F.col("role") == ADMIN, F.col("role")).otherwise(F.coalesce("_role", F.lit("sales")))
    values = {"name": F.col("_name"), "display": F.col("_name"), "guid": F.coalesce("_guid", "guid"), "email": F.coalesce("_email", "email"), "role": role, "active": F.lit(True), "source": F.lit(source)}
    columns = ["user_id", "username", "name", "display", "guid", "email", "role", "active", "source"]
    out = out.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in columns], F.when(hit, "updated").alias("action"))
    new = rows.filter("user_id is null").withColumn("_who", F.coalesce("guid", F.lower("name")))
    new = last(last(new, "_who").withColumn("_who", F.lower("name")), "_who").withColumn("base", base_name(F.col("name"), F.col("email")))
    names = free_names(new.select(F.col("seq").cast("long").alias("seq"), "base"), users)
    top, low = users.agg(F.coalesce(F.max("user_id"), F.lit(0))).first()[0], new.agg(F.min("seq")).first()[0]
    made = new.join(names, "seq").select(
        (F.col("seq") + F.lit(top + 1 - (low or 0))).cast("long").alias("user_id"), "username", "name", F.col("name").alias("display"), "guid", "email", F.coalesce("role", F.lit("sales")).alias("role"),
        F.lit(True).alias("active"), F.lit(source).alias("source"), F.lit("created").alias("action"),
    )
    return out.unionByName(made)
