"""User creates and edits, product edits and generated codes against plain models."""

import random

import pytest
import sequential
from conftest import rows
from helpers import make_tables, ts
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.plans import edits, members

L, S = T.LongType(), T.StringType()
USER_REQ = T.StructType([T.StructField("request_id", L), T.StructField("user_id", L), T.StructField("username", S), T.StructField("role", S),
                         T.StructField("team_id", L), T.StructField("balance", L), T.StructField("requested_at", T.TimestampNTZType())])


def _check(spark, users, teams, reqs, partitions=3):
    t = make_tables(spark, users=users, teams=teams)
    req = spark.createDataFrame(reqs, USER_REQ)
    got = members.edit_users(t.users, t.teams, req, partitions=partitions)
    results, people, leader, ledger = sequential.user_fold(rows(t.users), rows(t.teams), rows(req))
    assert {r["request_id"]: (r["user_id"], r["accepted"], r["reason"]) for r in rows(got["results"])} == results
    assert {r["id"]: r for r in rows(got["users"])} == people
    assert {r["id"]: r["leader_id"] for r in rows(got["teams"])} == leader
    assert sorted((r["request_id"], r["user_id"], r["amount"]) for r in rows(got["ledger"])) == sorted(ledger)


@pytest.mark.parametrize("seed", range(10))
def test_user_edits_random_logs(spark, seed):
    rnd = random.Random(seed)
    roles = ["team_leader", "team_leader", "participant", "admin"]
    users = [(i, f"u{i}", rnd.choice(roles), rnd.choice([1, 2, 3, None]), rnd.randint(0, 9), ts(0)) for i in range(1, 8)]
    teams = [(i, f"t{i}", rnd.choice([None, 1, 2, 3, 4, 5]), ts(0)) for i in (1, 2, 3, 4)]
    reqs = []
    for k in range(rnd.choice([4, 9, 30])):
        uid = rnd.choice([None, 1, 2, 3, 4, 5, 6, 7, 8])
        name = rnd.choice([f"u{uid}", f"u{uid}", f"u{uid}", f"u{rnd.randint(1, 7)}", f"n{rnd.randint(0, 5)}", "", None])
        reqs.append((k, uid, name, rnd.choice([*roles, "owner", None]) if rnd.random() < 0.2 else rnd.choice(roles), rnd.choice([1, 2, 3, 3, None, 9]),
                     rnd.choice([None, None, 0, 5, 7]), ts(rnd.randint(0, 20))))
    _check(spark, users, teams, reqs)


def test_user_edits_of_one_hot_user_and_team(spark):
    rnd = random.Random(7)
    users = [(i, f"u{i}", "participant", 1, 0, ts(0)) for i in range(1, 30)]
    reqs = []
    for k in range(400):
        uid = 1 if rnd.random() < 0.8 else rnd.randint(2, 29)
        reqs.append((k, uid, f"u{uid}", rnd.choice(["team_leader", "participant"]), rnd.choice([1, 1, 1, 2]), rnd.choice([None, k % 5]), ts(rnd.randint(0, 300))))
    _check(spark, users, [(1, "t1", 3, ts(0)), (2, "t2", 1, ts(0))], reqs, partitions=6)


def test_user_edits_of_nothing(spark):
    _check(spark, [(1, "a", "team_leader", 1, 0, ts(0))], [(1, "t", 1, ts(0))], [])
    _check(spark, [], [], [(1, None, "a", "participant", None, None, ts(0)), (2, None, "a", "participant", None, None, ts(1))])


def test_generated_codes_are_unique_and_redrawn(spark):
    schema = "request_id long, amount long, quantity int, requested_at timestamp_ntz"
    req = spark.createDataFrame([(1, 10, 6, ts(0)), (2, 20, 5, ts(0)), (3, 0, 4, ts(0)), (4, 5, 0, ts(0)), (5, None, None, ts(0))], schema)
    first = edits.generated_codes(req.filter("request_id = 1")).first()["code"]
    codes = rows(edits.generated_codes(req, spark.createDataFrame([(first,)], "code string")))
    assert len(codes) == 11 and len({c["code"] for c in codes}) == 11 and first not in {c["code"] for c in codes}
    assert all(c["code"].startswith("RC1704067200000") and len(c["code"]) == 21 for c in codes)
    reasons = {r["request_id"]: r["reason"] for r in rows(edits.code_request_results(req))}
    assert reasons == {1: None, 2: None, 3: "amount_not_positive", 4: "quantity_below_one", 5: "amount_not_positive"}

    def narrow(slots):
        # so few values that most first draws collide
        return slots.withColumn("code", F.concat(F.lit("RC"), F.pmod(F.xxhash64("request_id", "n", "attempt"), F.lit(12)).cast("string")))

    few = rows(edits.generated_codes(req, spark.createDataFrame([("RC0",)], "code string"), draw=narrow))
    assert sorted(c["code"] for c in few) == sorted(f"RC{k}" for k in range(1, 12))
    assert sorted((c["request_id"], c["n"]) for c in few) == [(1, n) for n in range(1, 7)] + [(2, n) for n in range(1, 6)]


def test_product_edit_guard_and_defaults(spark):
    prods = [(i, f"p{i}", "old", 5, "A", 3, 3, True, ts(0)) for i in range(1, 6)]
    t = make_tables(spark, products=prods)
    schema = "id long, name string, description string, price long, category string, stock_quantity long, request_id long, edited_at timestamp_ntz"
    e = spark.createDataFrame([(1, "n", None, 7, "", None, 1, ts(0)), (2, "", "d", 7, "c", 1, 2, ts(0)), (3, "n", "d", 0, "c", 1, 3, ts(0)),
                               (4, "n", "d", 7, "c", -1, 4, ts(0)), (5, "a", "d", 8, "c", 9, 5, ts(0)), (5, "b", "", 9, "c", None, 6, ts(1))], schema)
    got = {r["id"]: (r["name"], r["description"], r["price"], r["category"], r["stock_quantity"]) for r in rows(edits.apply_product_edits(t.products, e))}
    assert got == {1: ("n", "", 7, "item", 3), 5: ("b", "", 9, "c", 9), **{i: (f"p{i}", "old", 5, "A", 3) for i in (2, 3, 4)}}
