"""Queries about sessions of parsed uploads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import sessions
from .plans.catalog import table
from .queries import query

# sessions: one per purchase, of a batch per user; every signup and click asks for one of them

NOW = "2024-01-20 00:00:00"
DAYS = 10


def _sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return e.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session_id"), (F.col("user_id") % 3).cast("string").alias("batch_key"), F.col("ts").alias("saved_at"))


def _requests(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type <> 'purchase'")
    k = F.col("event_id")
    return e.select(k.alias("request_id"), F.concat(F.lit("s"), (k + 1).cast("string")).alias("session_id"), (F.col("user_id") % 3).cast("string").alias("batch_key"), (k % 5 == 0).alias("force"), (k % 4 != 0).alias("has_data"))


_NOW = f"timestamp '{NOW}'"
SESSIONS_SQL = f"""s as (select concat('s', event_id) as session_id, cast(user_id % 3 as varchar) as batch_key, ts as saved_at from events where event_type = 'purchase'),
r as (select event_id as request_id, concat('s', event_id + 1) as session_id, cast(user_id % 3 as varchar) as batch_key, event_id % 5 = 0 as force, event_id % 4 <> 0 as has_data from events where event_type <> 'purchase'),
alive as (select * from s where epoch_us({_NOW}) - epoch_us(saved_at) <= {DAYS} * 86400000000),
d as (select r.*, case when not force and coalesce(alive.batch_key = r.batch_key, false) then 'reuse' when has_data then 'parse' else 'refuse' end as decision from r left join alive using (session_id))"""


@query(f"with {SESSIONS_SQL} select request_id, decision from d")
def session_decisions(spark, sf_dir):
    return sessions.decided(_requests(spark, sf_dir), _sessions(spark, sf_dir), F.lit(NOW).cast("timestamp"), DAYS * 86_400).select("request_id", "decision")


@query(f"with {SESSIONS_SQL} select session_id, batch_key from alive where session_id not in (select session_id from d where decision = 'parse' or (decision = 'refuse' and not force)) union all select concat('new ', batch_key), batch_key from d where decision = 'parse'")
def sessions_after(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    rows = sessions.after(_requests(spark, sf_dir), _sessions(spark, sf_dir), now, DAYS * 86_400)
    return rows.select(F.when(F.col("session_id").startswith("dps_"), F.concat(F.lit("new "), "batch_key")).otherwise(F.col("session_id")).alias("session_id"), "batch_key")


@query(f"with {SESSIONS_SQL} select user_id, count(*) as n, round(sum(value), 4) as value from events join alive on alive.session_id = concat('s', event_id) group by user_id")
def committed_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("session_id", F.concat(F.lit("s"), F.col("event_id").cast("string")))
    rows = sessions.committed(e, _sessions(spark, sf_dir), e, F.lit(NOW).cast("timestamp"), DAYS * 86_400)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
