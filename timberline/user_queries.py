"""Queries about users synchronised from another system, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import users
from .plans.catalog import table
from .queries import query

# users: one customer in four; the other system reports these and one in four more, some without a name or as placeholders


def _people(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.select(k.alias("k"), F.concat("c_mktsegment", F.lit(" "), k.cast("string"), F.lit(" "), F.regexp_replace("n_name", " ", ""), F.lit("ia")).alias("person"))


def _users(spark, sf_dir):
    k, n = F.col("k"), F.col("k") % 7
    name = F.concat(users.base_name(F.col("person"), F.lit(None).cast("string")), F.when(n >= 2, n.cast("string")).otherwise(""))
    return _people(spark, sf_dir).filter("k % 4 = 0").select(
        k.cast("long").alias("user_id"), F.initcap(name).alias("username"), F.lit("?").alias("name"), F.upper("person").alias("display"), F.when(k % 8 == 0, F.concat(F.lit("g"), k.cast("string"))).alias("guid"),
        F.lit("old@x.org").alias("email"), F.when(k % 12 == 0, "admin").otherwise("sales").alias("role"), (k % 3 == 0).alias("active"), F.lit("local").alias("source"),
    )


def _incoming(spark, sf_dir):
    k = F.col("k")
    email = F.when(k % 5 == 0, F.concat(F.lit("Mail."), k.cast("string"), F.lit("@x.org")))
    name = F.when(k % 16 == 1, "Commission, No").when(k % 16 != 5, F.col("person"))
    return _people(spark, sf_dir).filter("k % 4 < 2").select(k.cast("long").alias("seq"), F.concat(F.lit("g"), k.cast("string")).alias("guid"), name.alias("name"), email.alias("email"), F.when(k % 3 == 0, "admin").when(k % 3 == 1, "floor").alias("role"))


USERS_SQL = """people as (select c_custkey as k, concat(c_mktsegment, ' ', c_custkey, ' ', replace(n_name, ' ', ''), 'ia') as person,
  regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '', 'g') || '.' || regexp_replace(lower(replace(n_name, ' ', '') || 'ia'), '[^a-z0-9]+', '', 'g') as base from customer join nation on c_nationkey = n_nationkey),
u as (select k as user_id, upper(substr(base, 1, 1)) || substr(base, 2) || case when k % 7 >= 2 then cast(k % 7 as varchar) else '' end as username, upper(person) as display, case when k % 8 = 0 then concat('g', k) end as guid,
  case when k % 12 = 0 then 'admin' else 'sales' end as role, k % 3 = 0 as active from people where k % 4 = 0),
i as (select k, person, case when k % 5 = 0 then concat('mail.', k) else base end as base, case when k % 5 = 0 then concat('Mail.', k, '@x.org') end as email, case k % 3 when 0 then 'admin' when 1 then 'floor' end as role from people where k % 4 < 2 and k % 16 not in (1, 5)),
new as (select *, row_number() over (partition by base order by k) as r from i where k % 4 = 1),
free as (select base, n, row_number() over (partition by base order by n) as r from (select distinct base from new), range(1, 2000) t(n)
  where case when n = 1 then base else concat(base, n) end not in (select lower(username) from u))"""


@query(f"""with {USERS_SQL}
select u.user_id, username, coalesce(person, '?') as name, coalesce(person, display) as display, case when k is null then guid else concat('g', k) end as guid, coalesce(email, 'old@x.org') as email,
  case when k is null or u.role = 'admin' then u.role else coalesce(i.role, 'sales') end as role, k is not null or active as active, case when k is null then 'local' else 'synced' end as source, case when k is not null then 'updated' end as action
from u left join i on k = u.user_id
union all
select (select max(user_id) from u) + 1 + k - (select min(k) from new), case when n = 1 then base else concat(base, n) end, person, person, concat('g', k), email, coalesce(role, 'sales'), true, 'synced', 'created' from new join free using (base, r)""")
def synchronised_users(spark, sf_dir):
    return users.synchronised(_incoming(spark, sf_dir), _users(spark, sf_dir))
