"""Sessions of parsed uploads: a table of what was parsed, from which batch and when, and what a request reuses, parses or deletes.

Sessions: (session_id, batch_key, saved_at); their rows lie in a table of
their own, (session_id, ...).  Both are plain tables; a change gives the new
state of a table, which the caller writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: seconds that a session lives.
TTL = 86_400


def is_fresh(saved_at: Column, now: Column, ttl: float = TTL) -> Column:
    return F.coalesce(F.unix_micros(now) - F.unix_micros(saved_at.cast("timestamp")) <= int(ttl * 1_000_000), F.lit(False))


def purged(sessions: DataFrame, now: Column, ttl: float = TTL) -> DataFrame:
    """Sessions that are still alive; one without a time is not."""
    return sessions.filter(is_fresh(F.col("saved_at"), now, ttl))


def decided(requests: DataFrame, sessions: DataFrame, now: Column, ttl: float = TTL) -> DataFrame:
    """requests (request_id, session_id, batch_key, force, has_data) with `decision`: reuse, parse or refuse.

    A live session of the same batch is reused unless the request forces
    another parse.  To parse, the files' data must be there; a request
    without it is refused.
    """
    alive = purged(sessions, now, ttl).select("session_id", F.col("batch_key").alias("_batch"))
    out = requests.join(alive, "session_id", "left")
    reuse = ~F.coalesce("force", F.lit(False)) & F.coalesce(F.col("_batch") == F.col("batch_key"), F.lit(False))
    return out.select(*requests.columns, F.when(reuse, "reuse").when(F.coalesce("has_data", F.lit(False)), "parse").otherwise("refuse").alias("decision"))


def after(requests: DataFrame, sessions: DataFrame, now: Column, ttl: float = TTL) -> DataFrame:
    """Sessions (session_id, batch_key, saved_at) after the requests: expired ones and those that a request named but does not reuse are gone, parsed ones are new.

    A forced request without data is refused before anything is deleted.
    A new session's id is made of its request, so that a repeated run makes the same.
    """
    choice = decided(requests, sessions, now, ttl)
    stale = choice.filter("session_id is not null and (decision = 'parse' or (decision = 'refuse' and not coalesce(force, false)))").select("session_id").distinct()
    rest = purged(sessions, now, ttl).join(stale, "session_id", "left_anti").select("session_id", "batch_key", F.col("saved_at").cast("timestamp").alias("saved_at"))
    made = F.concat(F.lit("dps_"), F.substring(F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), "batch_key", now.cast("string")), 256), 1, 24))
    return rest.union(choice.filter("decision = 'parse'").select(made.alias("session_id"), "batch_key", now.alias("saved_at")))


def committed(rows: DataFrame, sessions: DataFrame, session_ids: DataFrame, now: Column, ttl: float = TTL) -> DataFrame:
    """The parsed rows of the named sessions (session_id) that are alive, without prices to customers."""
    alive = purged(sessions, now, ttl).select("session_id").join(session_ids.select("session_id").distinct(), "session_id", "left_semi")
    return rows.join(alive, "session_id", "left_semi").drop("adjusted_price", "multiplier")
