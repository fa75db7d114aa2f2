"""One test per decided quirk."""

from conftest import rows
from helpers import make_tables, ts

from coffer.operators import catalog, finance, rankings


def _one_team(spark, earned, donated):
    users = [(1, "l", "team_leader", 1, 0, ts(0))]
    tx = [(1, 1, "earn", earned, "e", None, ts(1)), (2, 1, "donation_sent", -donated, "d", 9, ts(2))]
    return make_tables(spark, users=users, teams=[(1, "t", 1, ts(0))], transactions=tx)


def test_q3_score_uses_double_arithmetic(spark):
    # 23/40*100 is 57.49999999999999 in doubles, so the score is 57, not 58
    r = rows(rankings.team_rankings(_one_team(spark, 40, 23)))[0]
    assert r["donation_score"] == 57


def test_q4_mean_balance_rounds_half_up(spark):
    users = [(1, "a", "participant", 1, -2, ts(0)), (2, "b", "participant", 1, -3, ts(0))]
    t = make_tables(spark, users=users, teams=[(1, "t", None, ts(0)), (2, "empty", None, ts(0))])
    got = {r["team_id"]: r for r in rows(finance.team_member_stats(t))}
    assert got[1]["average_balance"] == -2  # Math.round(-2.5) = -2
    assert got[2]["average_balance"] is None and got[2]["member_count"] == 0


def test_q1_q2_spent_differs_between_pages(spark):
    users = [(1, "l", "team_leader", 1, 77, ts(0))]
    tx = [(1, 1, "earn", 100, "e", None, ts(1)), (2, 1, "purchase", -10, "p", 1, ts(2)),
          (3, 1, "donation_sent", -20, "d", 2, ts(3)), (4, 1, "admin_adjustment", 5, "a", 3, ts(4))]
    t = make_tables(spark, users=users, teams=[(1, "t", 1, ts(0))], transactions=tx)
    rank = rows(rankings.team_rankings(t))[0]
    fin = rows(finance.team_finance(t))[0]
    assert rank["total_spent"] == 30 and rank["current_balance"] == 70
    assert fin["spent"] == 10 and fin["donated"] == 20 and fin["current_balance"] == 77


def test_q6_users_without_team_count_nowhere(spark):
    users = [(0, "root", "admin", None, 0, ts(0)), (1, "l", "team_leader", 1, 0, ts(0))]
    tx = [(1, 0, "earn", 999, "e", None, ts(1))]
    t = make_tables(spark, users=users, teams=[(1, "t", 1, ts(0))], transactions=tx)
    r = rows(rankings.team_rankings(t))[0]
    assert r["total_earned"] == 0 and r["member_count"] == 1


def test_q19_null_team_has_no_donation_targets(spark):
    t = make_tables(spark, teams=[(1, "a", None, ts(0)), (2, "b", None, ts(0))])
    assert rows(catalog.donation_targets(t, None)) == []
    assert [r["id"] for r in rows(catalog.donation_targets(t, 1))] == [2]


def test_p2_catalog_drops_inactive_and_defaults_stock(spark):
    prods = [(1, "x", None, 5, "A", None, 3, True, ts(0)), (2, "y", "d", 5, "A", 4, 4, False, ts(0)),
             (3, "z", "d", 5, "A", 4, 4, None, ts(0))]
    t = make_tables(spark, products=prods)
    got = rows(catalog.store_catalog(t))
    assert [(r["id"], r["stock_quantity"], r["stock_status"]) for r in got] == [(1, 0, "sold_out")]


def test_d10_toggle_latest_request_wins(spark):
    from pyspark.sql import types as T

    from coffer.plans import edits

    prods = [(1, "x", None, 5, "A", 3, 3, True, ts(0)), (2, "y", None, 5, "A", 3, 3, False, ts(0))]
    t = make_tables(spark, products=prods)
    schema = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("product_id", T.LongType()),
                           T.StructField("is_active", T.BooleanType()),
                           T.StructField("requested_at", T.TimestampNTZType())])
    req = spark.createDataFrame([(1, 1, False, ts(1)), (2, 1, True, ts(2)), (3, 2, True, ts(1))], schema)
    got = {r["id"]: r["is_active"] for r in rows(edits.toggle_products(t.products, req))}
    assert got == {1: True, 2: True}


def test_q13_set_zero_keeps_flag_and_edit_keeps_stock(spark):
    from pyspark.sql import types as T

    from coffer.plans import edits

    prods = [(1, "x", None, 5, "A", 3, 3, True, ts(0))]
    t = make_tables(spark, products=prods)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.LongType()),
                           T.StructField("stock_quantity", T.LongType())])
    edited = rows(edits.apply_product_edits(t.products, spark.createDataFrame([(1, 9, None)], schema)))[0]
    assert edited["price"] == 9 and edited["stock_quantity"] == 3 and edited["is_active"] is True


def test_q5_equal_scores_rank_by_name_without_shared_ranks(spark):
    users = [(1, "a", "team_leader", 1, 0, ts(0)), (2, "b", "team_leader", 2, 0, ts(0))]
    tx = [(1, 1, "earn", 10, "e", None, ts(1)), (2, 2, "earn", 20, "e", None, ts(1))]
    t = make_tables(spark, users=users, teams=[(1, "zeta", 1, ts(0)), (2, "alpha", 2, ts(0))], transactions=tx)
    got = sorted(rows(rankings.team_rankings(t)), key=lambda r: r["position"])
    assert [(r["team_name"], r["position"]) for r in got] == [("alpha", 1), ("zeta", 2)]


def test_q9_inventory_entries_count_is_one_per_key(spark):
    from coffer.operators import inventory as inv_ops
    from coffer.plans import inventory

    orders = [(f"o{i}", 1, 1, 7, 1, 10, "pending", False, ts(i)) for i in range(3)]
    prods = [(7, "p", None, 10, "c", 5, 5, True, ts(0))]
    t = make_tables(spark, orders=orders, products=prods)
    t = t.with_(team_inventory=inventory.materialise(inventory.inventory_events(t.orders, t.donations)))
    r = rows(inv_ops.team_inventory(t))[0]
    assert r["total_quantity"] == 3 and r["entries_count"] == 1
    s = rows(inv_ops.inventory_summary(t))[0]
    assert s["total_items"] == 3 and s["total_value"] == 30  # Q26: numbers, not joined text


def test_q15_product_guard_takes_zero_stock_refuses_null_and_negative(spark):
    from pyspark.sql import types as T

    from coffer.operators import checks

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("price", T.LongType()), T.StructField("stock_quantity", T.LongType())])
    req = spark.createDataFrame([(1, "a", 5, 0), (2, "b", 5, None), (3, "c", 5, -1), (4, "", 5, 1),
                                 (5, "e", 0, 1), (6, " ", 5, 1), (7, None, 5, 1)], schema)
    got = {r["id"]: r["reject_reason"] for r in rows(checks.guard_product_requests(req))}
    assert got == {1: None, 2: "stock_negative_or_missing", 3: "stock_negative_or_missing",
                   4: "name_required", 5: "price_not_positive", 6: None, 7: "name_required"}


def test_q18_categories_are_case_sensitive(spark):
    prods = [(1, "x", None, 5, "Item", 3, 3, True, ts(0)), (2, "y", None, 5, "item", 3, 3, True, ts(0))]
    t = make_tables(spark, products=prods)
    assert [r["category"] for r in rows(catalog.catalog_categories(t))] == ["Item", "item"]


def test_q20_q28_board_counts_cancelled_as_pending_and_in_sales(spark):
    from coffer.operators import orders as order_ops

    users = [(1, "a", "team_leader", 1, 0, ts(0)), (2, "b", "team_leader", 2, 0, ts(0))]
    teams = [(1, "t1", 1, ts(0)), (2, "t2", 2, ts(0))]
    prods = [(7, "p", None, 10, "c", 5, 5, True, ts(0))]
    orders = [("o1", 1, 1, 7, 1, 10, "cancelled", False, ts(1)), ("o2", 1, 1, 7, 2, 20, "verified", True, ts(2))]
    dons = [("d1", 1, 2, 1, 2, 7, 30, 3, "", ts(3))]
    t = make_tables(spark, users=users, teams=teams, products=prods, orders=orders, donations=dons)
    s = rows(order_ops.order_board_summary(t))[0]
    assert (s["pending_count"], s["verified_count"], s["total_sales"]) == (1, 2, 60)
    board = rows(order_ops.admin_orders(t))
    assert [r["id"] for r in board] == ["d1", "o2", "o1"]
    assert board[0]["recipient_team_name"] == "t2" and board[1]["recipient_team_name"] is None


def test_q22_q24_leader_status_reports_mismatch_and_null_role_passes(spark):
    from coffer.operators import checks

    users = [(1, "a", "participant", 2, 0, ts(0)), (2, "b", "team_leader", 2, 0, ts(0))]
    teams = [(1, "t1", 1, ts(0)), (2, "t2", 2, ts(0)), (3, "t3", None, ts(0)), (4, "t4", 99, ts(0))]
    t = make_tables(spark, users=users, teams=teams)
    got = {r["team_id"]: r["status"] for r in rows(checks.leader_status(t))}
    assert got == {1: checks.LEADER_MISMATCH, 2: checks.LEADER_OK, 3: checks.LEADER_MISSING, 4: checks.LEADER_OK}


def test_q7_donation_received_rows_carry_zero(spark):
    import datetime as dt

    from pyspark.sql import types as T

    from coffer.plans import admit

    users = [(1, "donor", "team_leader", 1, 100, ts(0)), (2, "lead2", "team_leader", 2, 0, ts(0))]
    teams = [(1, "t1", 1, ts(0)), (2, "t2", 2, ts(0))]
    prods = [(7, "p", None, 10, "c", 5, 5, True, ts(0))]
    t = make_tables(spark, users=users, teams=teams, products=prods)
    schema = T.StructType([
        T.StructField("request_id", T.StringType()), T.StructField("user_id", T.LongType()),
        T.StructField("kind", T.StringType()), T.StructField("recipient_team_id", T.LongType()),
        T.StructField("product_id", T.LongType()), T.StructField("quantity", T.LongType()),
        T.StructField("message", T.StringType()), T.StructField("requested_at", T.TimestampNTZType())])
    req = spark.createDataFrame([("r1", 1, "donate", 2, 7, 2, "hi", dt.datetime(2024, 1, 2))], schema)
    a = admit.admit(t.users, t.products, t.teams, req)
    led = {r["type"]: r for r in rows(admit.posted_ledger(a.accepted, t.users, t.teams))}
    assert led["donation_sent"]["amount"] == -20 and led["donation_received"]["amount"] == 0
    assert led["donation_received"]["user_id"] == 2
    d = rows(admit.posted_donations(a.accepted, t.users))[0]
    assert d["recipient_id"] == 2 and d["message"] == "hi"
    assert rows(admit.stock_after(t.products, a.accepted))[0]["stock_quantity"] == 3


def test_q14_adjust_does_not_reactivate_product_switched_off_with_stock(spark):
    from pyspark.sql import types as T

    from coffer.plans import stock

    prods = [(1, "x", None, 5, "A", 4, 4, False, ts(0)), (2, "y", None, 5, "A", 0, 4, False, ts(0))]
    t = make_tables(spark, products=prods)
    schema = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("product_id", T.LongType()),
                           T.StructField("type", T.StringType()), T.StructField("adjustment", T.LongType()),
                           T.StructField("requested_at", T.TimestampNTZType())])
    req = spark.createDataFrame([(1, 1, "adjust", 3, ts(1)), (2, 2, "adjust", 3, ts(1))], schema)
    got = {r["id"]: (r["stock_quantity"], r["is_active"]) for r in rows(stock.adjust_stock(t.products, req).products)}
    assert got == {1: (7, False), 2: (3, True)}
