"""Iterative jobs against plain sequential models (SURVEY §5 (d), (e))."""

import random

import pytest
import sequential
from conftest import SF_SMALL, rows
from helpers import make_tables, ts
from pyspark.sql import types as T

from coffer.plans import admit, leaders, stock
from coffer.sources import fixtures
from coffer.streaming import jobs as streams

STORE_REQ = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("user_id", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("recipient_team_id", T.LongType()),
    T.StructField("product_id", T.LongType()), T.StructField("quantity", T.LongType()),
    T.StructField("message", T.StringType()), T.StructField("requested_at", T.TimestampNTZType())])


def _random_store(spark, seed):
    rnd = random.Random(seed)
    roles = ["team_leader", "participant", "admin"]
    users = [(i, f"u{i}", rnd.choice(roles), rnd.choice([1, 2, 3, None]), rnd.randint(-5, 60), ts(0))
             for i in range(1, 7)]
    teams = [(i, f"t{i}", None, ts(0)) for i in (1, 2, 3)]
    prods = [(i, f"p{i}", None, rnd.randint(0, 6), "c", rnd.choice([0, 1, 3, 5, None]), 5,
              rnd.choice([True, True, False, None]), ts(0)) for i in range(1, 6)]
    reqs = []
    for k in range(60):
        donate = rnd.random() < 0.35
        reqs.append((f"r{k:03d}", rnd.randint(1, 7), "donate" if donate else "purchase",
                     rnd.choice([1, 2, 3, 9, None]) if donate else None, rnd.choice([1, 2, 3, 4, 5, 6]),
                     rnd.choice([1, 1, 2, 3, 0, -1]), "", ts(rnd.randint(0, 20))))
    t = make_tables(spark, users=users, teams=teams, products=prods)
    return t, spark.createDataFrame(reqs, STORE_REQ)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("guard", [True, False])
def test_admission_random_logs(spark, seed, guard):
    t, req = _random_store(spark, seed)
    a = admit.admit(t.users, t.products, t.teams, req, role_guard=guard, partitions=3)
    got = {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(a.results)}
    want = sequential.admission(rows(t.users), rows(t.products), rows(t.teams), rows(req), role_guard=guard)
    assert got == want


@pytest.mark.parametrize("guard", [True, False])
def test_admission_matches_sequential_on_store_log(spark, guard):
    t = fixtures.load_tables(spark, SF_SMALL)
    req = fixtures.store_requests(spark, SF_SMALL)
    a = admit.admit(t.users, t.products, t.teams, req, role_guard=guard)
    got = {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(a.results)}
    want = sequential.admission(rows(t.users), rows(t.products), rows(t.teams), rows(req), role_guard=guard)
    assert got == want
    # posting: stock and balances after equal the model's end state
    acc = [k for k, v in want.items() if v[0]]
    assert a.accepted.count() == len(acc)
    after = {r["id"]: r["stock_quantity"] for r in rows(admit.stock_after(t.products, a.accepted))}
    used = {}
    for r in rows(req):
        if want[r["request_id"]][0]:
            used[r["product_id"]] = used.get(r["product_id"], 0) + r["quantity"]
    for p in rows(t.products):
        if p["id"] in used:
            assert after[p["id"]] == (p["stock_quantity"] or 0) - used[p["id"]]


LEADER_REQ = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("leader_id", T.LongType()),
    T.StructField("team_id", T.LongType()), T.StructField("requested_at", T.TimestampNTZType())])


@pytest.mark.parametrize("seed", range(8))
def test_leader_fold_random_logs(spark, seed):
    rnd = random.Random(seed)
    users = [(i, f"u{i}", rnd.choice(["team_leader", "participant", "admin"]), rnd.choice([1, 2, 3, None]), 0,
              ts(0)) for i in range(1, 9)]
    teams = [(i, f"t{i}", rnd.choice([None, 1, 2, 3, 4, 5]), ts(0)) for i in (1, 2, 3)]
    reqs = [(k, rnd.randint(1, 8), rnd.choice([1, 2, 3]), ts(rnd.randint(0, 30))) for k in range(25)]
    t = make_tables(spark, users=users, teams=teams)
    req = spark.createDataFrame(reqs, LEADER_REQ)
    new = leaders.assign_leaders(t.users, t.teams, req)
    role, leader = sequential.leader_assignment(rows(t.users), rows(t.teams), rows(req))
    assert {r["id"]: r["role"] for r in rows(new["users"])} == role
    assert {r["id"]: r["leader_id"] for r in rows(new["teams"])} == leader


STOCK_REQ = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("product_id", T.LongType()),
    T.StructField("type", T.StringType()), T.StructField("adjustment", T.LongType()),
    T.StructField("requested_at", T.TimestampNTZType())])


@pytest.mark.parametrize("seed", range(6))
def test_stock_fold_random_logs(spark, seed):
    rnd = random.Random(seed)
    prods = [(i, f"p{i}", None, 5, "c", rnd.choice([0, 2, 7, None]), 5, rnd.choice([True, False]), ts(0))
             for i in range(1, 4)]
    reqs = [(k, rnd.randint(1, 4), rnd.choice(["set", "adjust", "adjust", "adjust"]),
             rnd.choice([-6, -3, -1, 0, 2, 4, None]), ts(rnd.randint(0, 40))) for k in range(50)]
    t = make_tables(spark, products=prods)
    req = spark.createDataFrame(reqs, STOCK_REQ)
    run = stock.adjust_stock(t.products, req, partitions=3)
    state, want = sequential.stock_fold(rows(t.products), rows(req))
    assert {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(run.results)} == want
    assert {r["id"]: (r["stock_quantity"], r["is_active"]) for r in rows(run.products)} == {
        k: (v["stock"], v["active"]) for k, v in state.items()}


def test_stock_stream_equals_batch(spark):
    t = fixtures.load_tables(spark, SF_SMALL)
    req = fixtures.stock_adjustments(spark, SF_SMALL)
    batch = stock.adjust_stock(t.products, req).results
    stream = streams.run_stock(spark, req, t.products, pieces=3)
    cols = ["request_id", "accepted", "reason", "stock_before", "stock_after"]
    key = lambda r: r["request_id"]
    assert sorted(rows(batch.select(cols)), key=key) == sorted(rows(stream.select(cols)), key=key)


def test_running_sums_scan_their_table_once_a_key_and_once_for_the_rows(spark):
    import contextlib
    import io

    from coffer.session import materialize

    w = materialize(spark.range(100).selectExpr(
        "id AS request_id", "timestamp_seconds(id) AS requested_at", "id % 3 AS user_id", "id % 5 AS product_id", "0 AS chunk_u",
        "0 AS chunk_p", "1L AS quantity", "2L AS total", "9L AS start_stock", "9L AS start_balance", "0L AS base_p", "0L AS base_u",
        "'open' AS state"), "plan-round")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        admit._round(w).explain()
    assert text.getvalue().count("FileScan parquet") == 3


def test_admission_hot_user_and_product(spark):
    """One user and one product carry most of the log: they are split over several chunks."""
    users = [(1, "hot", "team_leader", 1, 400, ts(0)), (2, "b", "team_leader", 2, 50, ts(0))]
    teams = [(1, "t1", None, ts(0)), (2, "t2", None, ts(0))]
    prods = [(1, "p1", None, 3, "c", 90, 90, True, ts(0)), (2, "p2", None, 1, "c", 5, 5, True, ts(0))]
    rnd = random.Random(7)
    reqs = [(f"r{k:04d}", 1 if rnd.random() < 0.8 else 2, "purchase", None, 1 if rnd.random() < 0.8 else 2,
             rnd.choice([1, 2, 3]), "", ts(k)) for k in range(300)]
    t = make_tables(spark, users=users, teams=teams, products=prods)
    req = spark.createDataFrame(reqs, STORE_REQ)
    a = admit.admit(t.users, t.products, t.teams, req, role_guard=True, partitions=6)
    got = {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(a.results)}
    assert got == sequential.admission(rows(t.users), rows(t.products), rows(t.teams), rows(req))


@pytest.mark.parametrize("seed", range(3))
def test_stock_fold_hot_product(spark, seed):
    rnd = random.Random(100 + seed)
    prods = [(i, f"p{i}", None, 5, "c", rnd.choice([0, 2, 7]), 5, True, ts(0)) for i in range(1, 3)]
    reqs = [(k, 1 if rnd.random() < 0.8 else 2, rnd.choice(["set", "adjust", "adjust", "adjust"]),
             rnd.choice([-6, -3, -1, 0, 2, 4]), ts(k)) for k in range(120)]
    t = make_tables(spark, products=prods)
    req = spark.createDataFrame(reqs, STOCK_REQ)
    run = stock.adjust_stock(t.products, req, partitions=5)
    state, want = sequential.stock_fold(rows(t.products), rows(req))
    assert {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(run.results)} == want
    assert {r["id"]: (r["stock_quantity"], r["is_active"]) for r in rows(run.products)} == {
        k: (v["stock"], v["active"]) for k, v in state.items()}


CREDIT = T.StructType([T.StructField("credit_id", T.LongType()), T.StructField("user_id", T.LongType()),
                       T.StructField("amount", T.LongType()), T.StructField("credited_at", T.TimestampNTZType())])


@pytest.mark.parametrize("seed", range(4))
def test_admission_with_interleaved_credits(spark, seed):
    t, req = _random_store(spark, seed)
    rnd = random.Random(50 + seed)
    cr = spark.createDataFrame([(k, rnd.randint(1, 6), rnd.choice([5, 10, 40]), ts(rnd.randint(0, 20)))
                                for k in range(15)], CREDIT)
    a = admit.admit(t.users, t.products, t.teams, req, credits=cr, role_guard=False, partitions=3)
    got = {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(a.results)}
    want = sequential.admission(rows(t.users), rows(t.products), rows(t.teams), rows(req), role_guard=False,
                                credits=rows(cr))
    assert got == want


def test_admission_with_credits_of_another_log(spark):
    t, req = _random_store(spark, 11)
    rnd = random.Random(61)
    cr = spark.createDataFrame([(k, rnd.randint(1, 6), rnd.choice([5, 10, 40]), ts(rnd.randint(0, 20)))
                                for k in range(15)], CREDIT)
    a = admit.admit(t.users, t.products, t.teams, req, credits=cr, role_guard=False, partitions=3)
    got = {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(a.results)}
    assert got == sequential.admission(rows(t.users), rows(t.products), rows(t.teams), rows(req),
                                       role_guard=False, credits=rows(cr))


def test_admission_with_redemption_credits_on_store_log(spark):
    from coffer.plans import redeem

    t = fixtures.load_tables(spark, SF_SMALL)
    won = redeem.redeem_codes(t.users, t.money_codes, fixtures.redemption_requests(spark, SF_SMALL))["results"]
    cr = won.filter("accepted").selectExpr("request_id AS credit_id", "user_id", "amount",
                                           "requested_at AS credited_at")
    req = fixtures.store_requests(spark, SF_SMALL)
    a = admit.admit(t.users, t.products, t.teams, req, credits=cr)
    got = {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(a.results)}
    assert got == sequential.admission(rows(t.users), rows(t.products), rows(t.teams), rows(req),
                                       credits=rows(cr))


def _fed(spark, fold, parts):
    """The store after the parts have arrived in this order, through a stream."""
    streams.feed(spark, parts, "parts", fold.batch)
    return fold.close(spark)


def _stock_log(spark, rows_):
    return spark.createDataFrame(rows_, STOCK_REQ)


RESULT = ["request_id", "accepted", "reason", "stock_before", "stock_after"]


def by_id(df, cols=RESULT):
    return sorted(rows(df.select(cols)), key=lambda r: r["request_id"])


def test_stock_stream_orders_out_of_order_arrivals(spark):
    import datetime as dt

    from coffer.session import scratch_path

    t = make_tables(spark, products=[(1, "x", None, 5, "A", 2, 2, True, ts(0))])
    base = dt.datetime(2024, 1, 1)
    early = [(1, 1, "adjust", -2, base + dt.timedelta(minutes=1)), (2, 1, "adjust", 5, base + dt.timedelta(minutes=2))]
    later = [(3, 1, "adjust", -4, base + dt.timedelta(minutes=3)), (4, 1, "set", 0, base + dt.timedelta(minutes=4)), (5, 1, "adjust", 1, None)]
    whole = _stock_log(spark, early + later)
    store = _fed(spark, streams.stock_fold(spark, scratch_path(spark, "ooo"), whole, t.products), [_stock_log(spark, later), _stock_log(spark, early)])
    assert by_id(store.read("results")) == by_id(stock.adjust_stock(t.products, whole).results)


def test_stock_stream_detects_requests_beyond_the_delay(spark):
    import datetime as dt

    from coffer.session import scratch_path
    from coffer.sources.commits import TableStore

    t = make_tables(spark, products=[(1, "x", None, 5, "A", 2, 2, True, ts(0))])
    base = dt.datetime(2024, 1, 1)
    first = [(1, 1, "adjust", 1, base), (2, 1, "adjust", 1, base + dt.timedelta(hours=5))]
    straggler = [(3, 1, "adjust", 1, base - dt.timedelta(minutes=1))]
    path = scratch_path(spark, "late")
    fold = streams.stock_fold(spark, path, _stock_log(spark, first), t.products)
    with pytest.raises(RuntimeError, match="1 requests arrived later"):
        _fed(spark, fold, [_stock_log(spark, first), _stock_log(spark, straggler)])
    store = TableStore(spark, path)
    assert {r["request_id"]: r["accepted"] for r in rows(store.read("results"))} == {1: True, 2: True}
    assert [r["request_id"] for r in rows(store.read("late"))] == [3]


def test_stock_stream_of_a_hot_product(spark):
    """80 % of the requests name one product: same results and flags as one after the other, and its rows lie in several ranges."""
    import datetime as dt

    from coffer.plans.running import add_chunk
    from coffer.session import scratch_path

    rnd = random.Random(12)
    base = dt.datetime(2024, 1, 1)
    prods = [(i, f"p{i}", None, 5, "c", rnd.choice([0, 2, None]), 5, rnd.choice([True, False]), ts(0)) for i in range(1, 5)]
    t = make_tables(spark, products=prods)
    reqs = [(k, 1 if rnd.random() < 0.8 else rnd.randint(2, 5), rnd.choice(["set"] + ["adjust"] * 6), rnd.choice([-6, -3, -1, 0, 2, 4, None]),
             base + dt.timedelta(seconds=40 * k)) for k in range(400)]
    req = _stock_log(spark, reqs)
    fold = streams.stock_fold(spark, scratch_path(spark, "hot"), req, t.products, delay=600)
    store = _fed(spark, fold, [_stock_log(spark, reqs[i: i + 150]) for i in range(0, 400, 150)])
    state, want = sequential.stock_fold(rows(t.products), rows(req))
    assert {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(store.read("results"))} == want
    assert {r["id"]: (r["stock_quantity"], r["is_active"]) for r in rows(store.read("stock"))} == {
        k: (v["stock"], v["active"]) for k, v in state.items()}
    batch = stock.adjust_stock(t.products, req, flags=True).results
    assert by_id(store.read("results"), RESULT + ["is_active"]) == by_id(batch, RESULT + ["is_active"])
    chunks = add_chunk(req, "product_id", "chunk", 8).filter("product_id = 1").select("chunk").distinct().count()
    assert chunks >= 4


def test_redeem_stream_of_a_hot_code_equals_batch(spark):
    """80 % of the requests name one code; a replayed micro-batch, also one that broke off, changes nothing."""
    import datetime as dt

    from coffer.plans import redeem
    from coffer.session import scratch_path
    from coffer.sources.commits import TableStore

    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    t = make_tables(spark, users=[(i, f"u{i}", rnd.choice(["team_leader", "participant", "admin"]), 1, 0, ts(0)) for i in range(1, 20)],
                    money_codes=[(i, f"C{i}", 10 * i, 3 if i == 4 else None, None, ts(0)) for i in range(1, 9)])
    schema = "request_id long, user_id long, code string, requested_at timestamp_ntz"
    reqs = [(k, rnd.randint(1, 22), "C1" if rnd.random() < 0.8 else rnd.choice(["C2", "C3", "C4", "C99", "", None]), base + dt.timedelta(seconds=30 * k))
            for k in range(500)]
    mk = lambda r: spark.createDataFrame(r, schema)
    path = scratch_path(spark, "hotcode")
    fold = streams.redeem_fold(spark, path, mk(reqs), t.users, t.money_codes, delay=900)
    fold.batch(mk(reqs[250:300] + reqs[:250]), 0)
    seen = {n: sorted(map(repr, rows(TableStore(spark, path).read(n)))) for n in ("results", "taken", "waiting")}
    fold.batch(mk(reqs[:300]), 0)  # replayed after its commit
    assert {n: sorted(map(repr, rows(TableStore(spark, path).read(n)))) for n in seen} == seen and TableStore(spark, path).version() == 1

    def broken(store, ready):
        replace, append = step(store, ready)
        return replace, {**append, "results": append["results"].selectExpr("CAST(raise_error('lost') AS BIGINT) AS request_id")}

    step, fold.step = fold.step, broken
    with pytest.raises(Exception, match="lost"):
        fold.batch(mk(reqs[300:]), 1)
    assert {n: sorted(map(repr, rows(TableStore(spark, path).read(n)))) for n in seen} == seen
    fold.step = step
    fold.batch(mk(reqs[300:]), 1)
    got = fold.close(spark).read("results")
    want = redeem.redeem_codes(t.users, t.money_codes, mk(reqs))["results"]
    key = lambda r: r["request_id"]
    assert sorted(rows(got), key=key) == sorted(rows(want), key=key)


def test_team_totals_survive_a_crash_in_mid_write(spark):
    from coffer.operators import rankings
    from coffer.session import scratch_path
    from coffer.sources.commits import TableStore

    t = fixtures.load_tables(spark, SF_SMALL)
    half = t.transactions.filter("id % 2 = 0")
    path = scratch_path(spark, "st1crash")
    fold = streams.totals_fold(spark, path, t.transactions, t.users, t.teams)
    fold.batch(half, 0)
    before = rows(TableStore(spark, path).read("ranking").orderBy("position"))
    step = fold.step
    fold.step = lambda store, new: ({**step(store, new)[0], "ranking": store.read("ranking").selectExpr("raise_error('lost') AS id")}, {})
    with pytest.raises(Exception, match="lost"):
        fold.batch(t.transactions.filter("id % 2 = 1"), 1)
    assert rows(TableStore(spark, path).read("ranking").orderBy("position")) == before and len(before) > 0
    fold.step = step
    fold.batch(t.transactions.filter("id % 2 = 1"), 1)
    assert rows(fold.close(spark).read("ranking").orderBy("position")) == rows(rankings.team_rankings(t).orderBy("position"))


def test_admission_moves_rows_of_hot_keys_only(spark, monkeypatch):
    """Without a hot user or product no range exchange runs; requests that the start can't serve enter no round."""
    from coffer.plans import running

    def moved(*_, **__):
        raise AssertionError("rows were dealt by ranges")

    monkeypatch.setattr(running, "add_chunk", moved)
    monkeypatch.setattr(admit, "add_chunk", moved)
    users = [(i, f"u{i}", "team_leader", 1, 0 if i % 4 == 0 else 30, ts(0)) for i in range(1, 41)]
    teams = [(1, "t1", None, ts(0)), (2, "t2", None, ts(0))]
    prods = [(i, f"p{i}", None, 3, "c", 9, 9, True, ts(0)) for i in range(1, 41)]
    rnd = random.Random(3)
    reqs = [(f"r{k:04d}", 1 + k % 40, "purchase", None, 1 + k // 2 % 40, rnd.choice([1, 2, 5, 50]), "", ts(k)) for k in range(240)]
    t = make_tables(spark, users=users, teams=teams, products=prods)
    req = spark.createDataFrame(reqs, STORE_REQ)
    seen = []
    real = admit._round
    monkeypatch.setattr(admit, "_round", lambda w: (seen.append(w.count()), real(w))[1])
    a = admit.admit(t.users, t.products, t.teams, req, role_guard=True, partitions=4)
    got = {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(a.results)}
    assert got == sequential.admission(rows(t.users), rows(t.products), rows(t.teams), rows(req))
    assert seen[0] == sum(r[5] <= 9 and 3 * r[5] <= (0 if r[1] % 4 == 0 else 30) for r in reqs)


def test_hot_keys_are_cut_and_others_left(spark):
    from coffer.plans.running import add_hot_chunk

    df = spark.range(400).selectExpr("id AS request_id", "timestamp_seconds(id) AS requested_at", "IF(id % 2 = 0, -1L, id) AS k")
    got = rows(add_hot_chunk(df, "k", "chunk", 6))
    assert len(got) == 400 and {r["chunk"] for r in got if r["k"] != -1} == {-1}
    hot = [r["chunk"] for r in sorted(got, key=lambda r: r["request_id"]) if r["k"] == -1]
    assert hot == sorted(hot) and len(set(hot)) >= 4
    assert add_hot_chunk(df.filter("k <> -1"), "k", "chunk", 6).columns == df.columns


def _plan(df) -> str:
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def _cold_store(spark, users=40, products=40, log=240, seed=5, leaders=1):
    """Requests of many users for many products, none of them hot."""
    rnd = random.Random(seed)
    us = [(i, f"u{i}", "team_leader" if i % leaders == 0 else "participant", 1 + i % 2, rnd.choice([0, 20, 60]), ts(0)) for i in range(1, users + 1)]
    teams = [(1, "t1", None, ts(0)), (2, "t2", None, ts(0))]
    prods = [(i, f"p{i}", None, rnd.choice([1, 3]), "c", 9, 9, i % 9 != 0, ts(0)) for i in range(1, products + 1)]
    t = make_tables(spark, users=us, teams=teams, products=prods)
    reqs = [(f"r{k:04d}", rnd.randint(1, users + 1), rnd.choice(["purchase", "donate"]), rnd.choice([1, 2, 3, None]), rnd.randint(1, products + 1),
             rnd.choice([1, 2, 5, 0]), "m", ts(rnd.randint(0, 30))) for k in range(log)]
    return t, spark.createDataFrame(reqs, STORE_REQ)


@pytest.mark.parametrize("guard", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_requests_stay_with_their_products(spark, seed, guard):
    """Whole requests lie dealt by product: accepted ones are read there without an exchange of theirs, results move them once."""
    t, req = _cold_store(spark, seed=seed)
    a = admit.admit(t.users, t.products, t.teams, req, role_guard=guard, partitions=4)
    got = {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(a.results)}
    assert got == sequential.admission(rows(t.users), rows(t.products), rows(t.teams), rows(req), role_guard=guard)
    assert {r["request_id"] for r in rows(a.granted)} == {k for k, v in got.items() if v[0]} != set()
    # what goes by an exchange to be joined is the places won, not the requests
    assert "Bucketed: true" in _plan(a.granted) and "Exchange hashpartitioning(request_id" not in _plan(a.granted)
    moved = _plan(a.results.filter("user_id IS NOT NULL AND product_id IS NOT NULL"))
    assert "Bucketed: true" in moved and moved.count("REPARTITION_BY_NUM") == 1


def test_the_guard_bars_requests_before_they_go_to_their_products(spark, monkeypatch):
    t, req = _cold_store(spark, leaders=8)
    seen = []
    real = admit.materialize_dealt
    monkeypatch.setattr(admit, "materialize_dealt", lambda df, *more: (seen.append(df.count()), real(df, *more))[1])
    a = admit.admit(t.users, t.products, t.teams, req, role_guard=True, partitions=4)
    want = sequential.admission(rows(t.users), rows(t.products), rows(t.teams), rows(req), role_guard=True)
    assert {r["request_id"]: (r["accepted"], r["reason"]) for r in rows(a.results)} == want
    assert seen == [sum(v[1] != "forbidden" for v in want.values())] and seen[0] < 60


def test_repeated_requests_and_users(spark):
    """A request id stands for all requests that have it, whether or not the users' ids repeat too."""
    t, req = _cold_store(spark, log=120)
    twice = req.unionByName(req.limit(30))
    key = lambda r: tuple(map(str, r.values()))
    run = lambda users: admit.admit(users, t.products, t.teams, twice, role_guard=False, partitions=4)
    one = run(t.users)
    # a repeated user nobody buys for sends the same log through the chunks
    other = run(t.users.unionByName(spark.createDataFrame([(999, "x", "participant", 1, 0, ts(0))] * 2, t.users.schema)))
    assert sorted(rows(one.results), key=key) == sorted(rows(other.results), key=key)
    assert sorted(rows(one.granted), key=key) == sorted(rows(other.granted), key=key)
    assert one.results.count() > 150


def test_hot_keys_are_found_without_moving_rows(spark):
    from coffer.plans.running import has_hot_key

    df = spark.range(400).selectExpr("id AS a", "IF(id % 2 = 0, -1L, id) AS b", "IF(id % 2 = 0, NULL, id) AS c")
    assert not has_hot_key(df, ("a", "c"), 6) and has_hot_key(df, ("a", "b"), 6) and not has_hot_key(df.limit(0), ("a", "b"), 6)
    assert not has_hot_key(spark.range(12).selectExpr("id % 12 AS k"), ("k",), 6) and has_hot_key(spark.range(12).selectExpr("id % 6 AS k"), ("k",), 6)


def test_shuffle_files_go_with_their_step(spark):
    import glob
    import time

    from coffer.session import materialize, shuffles_dropped

    where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in where for f in glob.glob(f"{d}/*/shuffle_*.data")}
    df = spark.range(1000).repartition(3, "id")
    before = files()
    with shuffles_dropped(spark):
        materialize(df, "dropped")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
