"""Names of new users against a plain search for the first free one, and what a synchronisation keeps."""

from __future__ import annotations

import random

import pytest

from timberline.operators import users

USER = "user_id long, username string, name string, display string, guid string, email string, role string, active boolean, source string"
ROW = "seq long, guid string, name string, email string, role string"


@pytest.mark.parametrize("seed", range(4))
def test_free_names(spark, seed):
    """Without a base that is another's numbered name, each row takes the first free number as if rows came one by one."""
    rng = random.Random(seed)
    bases = ["ann.lee", "bo", "user", "x.y"]
    taken = {rng.choice(bases).title() + rng.choice(["", "2", "3", "02", "5", "12"]) for _ in range(9)}
    wanted = [(k, rng.choice(bases)) for k in range(40)]
    got = {r.seq: r.username for r in users.free_names(spark.createDataFrame(wanted, "seq long, base string"), spark.createDataFrame([(t,) for t in taken], "username string")).collect()}
    have, want = {t.lower() for t in taken}, {}
    for k, base in wanted:
        n = 1
        while (name := base + (str(n) if n > 1 else "")) in have:
            n += 1
        have.add(name)
        want[k] = name
    assert got == want


def test_bases_that_look_numbered(spark):
    """`a` is numbered into `a2` and `a22`, which are bases too: nobody shares a name."""
    wanted = [(k, "a") for k in range(25)] + [(30 + k, "a2") for k in range(4)] + [(40, "a22"), (41, "a3")]
    got = users.free_names(spark.createDataFrame(wanted, "seq long, base string"), spark.createDataFrame([("A2",), (None,)], "username string")).collect()
    names = [r.username for r in got]
    assert len(names) == len(wanted) and len(set(names)) == len(names) and "a2" not in names
    assert all(r.username.startswith(dict(wanted)[r.seq]) for r in got)


def test_bases(spark):
    rows = [("Miller, Judson", None, "judson.miller"), ("Anna Maria  Lee", "", "anna.lee"), (None, None, "user"), ("?!", None, "user"), ("Bo", "no address", "bo"), ("Bo", " B.O+1@x.org ", "b.o1"), ("Bo X", "@x.org", "bo.x")]
    got = spark.createDataFrame(rows, "name string, email string, want string")
    assert all(r.base == r.want for r in got.withColumn("base", users.base_name(got["name"], got["email"])).collect())


def test_synchronised(spark):
    old = spark.createDataFrame([(1, "ann", "Ann", "Ann", "g1", "a@x", "admin", False, "local"), (2, "bo", None, "Bo", None, "b@x", "sales", True, "local"), (3, "cy", "Cy", "Cy", "g3", None, "floor", False, "local")], USER)
    rows = [(1, "g1", "Ann B", "", "sales"), (2, "g9", "BO", None, "floor"), (3, None, " ", None, None), (4, "g4", "Commission, No", None, None), (5, "g5", "Bo", None, None), (6, "g6", "Dee", None, None), (7, "g6", "Dee Z", "bo@x", None), (8, None, "dee z", None, "floor")]
    got = {r.username: r for r in users.synchronised(spark.createDataFrame(rows, ROW), old).collect()}
    assert set(got) == {"ann", "bo", "cy", "dee.z"}
    assert (got["ann"].role, got["ann"].active, got["ann"].email, got["ann"].display, got["ann"].action) == ("admin", True, "a@x", "Ann B", "updated")
    assert (got["bo"].guid, got["bo"].role, got["bo"].action) == ("g5", "sales", "updated")
    assert got["cy"].action is None and not got["cy"].active
    assert (got["dee.z"].user_id, got["dee.z"].role, got["dee.z"].action) == (4, "floor", "created")
    assert users.synchronised(spark.createDataFrame([], ROW), old).count() == 3
    assert users.synchronised(spark.createDataFrame(rows, ROW), spark.createDataFrame([], USER)).count() == 3
