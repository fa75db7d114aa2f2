"""Golden cases taken from the application's own test scripts (numbers only)."""

from conftest import rows
from helpers import make_tables, ts

from coffer.operators import rankings
from coffer.plans import edits, inventory


def _teams_with_leaders(spark):
    users = [(i, f"leader{i}", "team_leader", i, 0, ts(i)) for i in range(1, 7)]
    teams = [(i, f"team{i}", i, ts(0)) for i in range(1, 7)]
    return make_tables(spark, users=users, teams=teams)


def test_sample_ledger_scores_ten_for_donating_teams(spark):
    t = _teams_with_leaders(spark)
    ledger = edits.sample_ledger(t.users, t.teams)
    tx = ledger.selectExpr("monotonically_increasing_id() AS id", "user_id", "type", "amount", "description",
                           "CAST(NULL AS BIGINT) AS reference_id", "TIMESTAMP_NTZ'2024-01-02' AS created_at")
    t = t.with_(transactions=tx)
    got = {r["id"]: r for r in rows(rankings.team_rankings(t))}
    assert [got[i]["donation_score"] for i in range(1, 7)] == [10, 10, 10, 10, 0, 0]
    assert got[1]["total_earned"] == 100000 and got[1]["total_donated"] == 10000
    assert got[3]["total_spent"] == 30000 + 15000
    pct = {r["id"]: r["donation_score_percent"] for r in rows(rankings.team_rankings_pct(t))}
    assert pct == {1: 10.0, 2: 10.0, 3: 10.0, 4: 10.0, 5: 0.0, 6: 0.0}
    # ties in score go by team name; positions 1..6 without gaps
    order = sorted(got.values(), key=lambda r: r["position"])
    assert [r["team_name"] for r in order] == ["team1", "team2", "team3", "team4", "team5", "team6"]
    assert order[0]["medal"] == "gold" and order[3]["medal"] is None


def _orders(spark, quantities, team=1, product=7):
    return [(f"o{i}", 1, team, product, q, q * 10, "pending", False, ts(i)) for i, q in enumerate(quantities)]


def test_two_purchases_add_up_to_three(spark):
    t = make_tables(spark, orders=_orders(spark, [1, 2]))
    inv = rows(inventory.materialise(inventory.inventory_events(t.orders, t.donations)))
    assert len(inv) == 1 and inv[0]["quantity"] == 3 and inv[0]["obtained_from"] == "purchase"
    assert inv[0]["reference_id"] == "o1"


def test_upsert_five_then_three_is_eight(spark):
    t = make_tables(spark, orders=_orders(spark, [5, 3]))
    ev = inventory.inventory_events(t.orders, t.donations)
    prior = inventory.materialise(ev.filter("event_id = 'o0'"))
    new = rows(inventory.upsert(prior, ev.filter("event_id = 'o1'")))
    assert new[0]["quantity"] == 8 and new[0]["reference_id"] == "o1"


def test_donation_upsert_two_then_three_is_five_from_donation(spark):
    d = [(f"d{i}", 1, None, 1, 2, 7, q * 10, q, "hi", ts(i)) for i, q in enumerate([2, 3])]
    t = make_tables(spark, donations=d)
    inv = rows(inventory.materialise(inventory.inventory_events(t.orders, t.donations)))
    assert inv[0]["quantity"] == 5 and inv[0]["obtained_from"] == "donation" and inv[0]["team_id"] == 2
    assert inv[0]["reference_id"] == "0"


def test_purchase_after_donation_keeps_donation_source(spark):
    d = [("d0", 1, None, 1, 1, 7, 10, 1, "", ts(0))]
    t = make_tables(spark, donations=d, orders=[("o1", 2, 1, 7, 1, 10, "pending", False, ts(5))])
    ev = inventory.inventory_events(t.orders, t.donations)
    prior = inventory.materialise(ev.filter("kind = 'donation'"))
    new = rows(inventory.upsert(prior, ev.filter("kind = 'purchase'")))
    assert new[0]["obtained_from"] == "donation" and new[0]["quantity"] == 2


def test_reset_keeps_only_admins(spark):
    users = [(0, "root", "admin", None, 500, ts(0)), (1, "a", "team_leader", 1, 10, ts(1)),
             (2, "b", "participant", 1, 10, ts(2))]
    t = make_tables(spark, users=users, teams=[(1, "t1", 1, ts(0))])
    kept = rows(edits.reset_users(t.users))
    assert [(r["id"], r["balance"]) for r in kept] == [(0, 0)]
    assert rows(edits.reset_teams(t.teams))[0]["leader_id"] is None
