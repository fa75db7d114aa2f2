"""One-pass rule report, whole reset, lookup by name, deletions, and the stored inventory in buckets."""

import glob

import pytest
from conftest import SF_SMALL, rows
from helpers import make_tables, ts
from test_plans import _plan

from coffer.operators import checks, directory
from coffer.plans import edits, inventory, posting
from coffer.schemas import DOMAINS, FOREIGN_KEYS, NOT_NULL, TABLE_SCHEMAS, UNIQUE_KEYS
from coffer.sources import fixtures
from coffer.sources.commits import TableStore
from coffer.sources.tables import Tables


def _by_hand(held):
    """The rule report over lists of dicts, row by row."""
    out = {}
    for table, cols in NOT_NULL.items():
        for c in cols:
            out["not_null", table, c] = sum(r[c] is None for r in held[table])
    for (table, c), allowed in DOMAINS.items():
        out["domain", table, c] = sum(r[c] is not None and r[c] not in allowed for r in held[table])
    for table, cols in UNIQUE_KEYS.items():
        keys = [tuple(r[c] for c in cols) for r in held[table]]
        out["unique", table, ",".join(cols)] = len({k for k in keys if None not in k and keys.count(k) > 1})
    for table, c, parent in FOREIGN_KEYS:
        known = {r["id"] for r in held[parent]}
        out["foreign_key", table, c] = sum(r[c] is not None and r[c] not in known for r in held[table])
    return out


def test_rule_report_equals_a_count_by_hand_and_every_rule_is_broken(spark):
    t = fixtures.damaged(fixtures.load_tables(spark, SF_SMALL))
    # repeated keys by hand are quadratic: the small tables do
    got = {(r["rule"], r["table_name"], r["column_names"]): r["violations"] for r in rows(checks.rule_violations(t))}
    held = {name: rows(df) for name, df in t.items()}
    want = _by_hand({**held, "team_inventory": held["team_inventory"][:0]})
    inv = [(r["team_id"], r["product_id"]) for r in held["team_inventory"] if r["team_id"] is not None and r["product_id"] is not None]
    for key, n in want.items():
        if key[1] != "team_inventory":
            assert got[key] == n, key
    assert got["unique", "team_inventory", "team_id,product_id"] == sum(1 for k in set(inv) if inv.count(k) > 1)
    assert got["not_null", "team_inventory", "quantity"] == sum(r["quantity"] is None for r in held["team_inventory"])
    assert len(got) == 46


def test_rule_report_of_empty_tables_has_a_row_for_every_rule(spark):
    got = rows(checks.rule_violations(make_tables(spark)))
    assert len(got) == 46 and all(r["violations"] == 0 for r in got)


def test_keys_with_separators_are_not_mixed_up(spark):
    teams = [(1, 'a","b'), (2, "a"), (3, "a"), (4, None), (5, None)]
    t = make_tables(spark).with_(teams=spark.createDataFrame(teams, "id long, name string"))
    got = {r["table_name"]: r["violations"] for r in rows(checks.rule_violations(t, ("unique",)))}
    assert got == {"users": 0, "teams": 1, "money_codes": 0, "team_inventory": 0}
    assert [(r["key_value"], r["dup_count"]) for r in rows(checks.check_unique(t))] == [("a", 2)]


def test_rule_report_reads_each_table_once_and_joins_nothing(spark, tmp_path):
    fixtures.load_tables(spark, SF_SMALL).write_parquet(str(tmp_path / "snap"))
    plan = _plan(checks.rule_violations(Tables.read_parquet(spark, str(tmp_path / "snap")))).split("\n\n")[0]
    assert plan.count("Scan parquet") == len(TABLE_SCHEMAS)
    assert "Join" not in plan
    # one by key, one of the totals
    assert plan.count("Exchange") == 2


def test_lookup_by_name(spark):
    t = make_tables(spark, users=[(1, "ann", "participant", 7, 5, ts(0)), (2, "bob", "admin", None, 9, ts(0)), (3, "cy", "participant", 8, 0, ts(0))],
                    teams=[(7, "red", None, ts(0))])
    keys = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, ""), (4, None), (5, "eve"), (6, "cy"), (7, "ann")], "request_id long, username string")
    got = {r["request_id"]: (r["user_id"], r["team_name"], r["reason"]) for r in rows(directory.login_lookup(t, keys))}
    assert got == {1: (1, "red", None), 2: (2, None, None), 3: (None, None, "username_required"), 4: (None, None, "username_required"),
                   5: (None, None, "unknown"), 6: (3, None, None), 7: (1, "red", None)}


def test_reset_is_one_commit_and_keeps_the_version_before(spark, tmp_path):
    t = fixtures.load_tables(spark, SF_SMALL)
    store = TableStore.create(spark, str(tmp_path / "store"), dict(t.items()))
    before = store.read("orders").count()
    assert posting.reset(store) == 1
    assert {n: store.read(n).count() for n in TABLE_SCHEMAS} == {
        "users": t.users.filter("role = 'admin'").count(), "teams": t.teams.count(), **{n: 0 for n in TABLE_SCHEMAS if n not in ("users", "teams")}}
    assert [r["balance"] for r in rows(store.read("users"))] == [0]
    names = {r["id"]: (r["name"], r["leader_id"]) for r in rows(store.read("teams"))}
    assert names[1] == (edits.RESET_TEAM_NAMES[1], None) and all(leader is None for _, leader in names.values())
    assert before > 0 and store.read("orders", version=0).count() == before
    assert store.read("orders").columns == t.orders.columns


def test_unsold_products_go_and_sold_ones_stay(spark):
    t = fixtures.with_unsold(fixtures.load_tables(spark, SF_SMALL))
    out = edits.delete_products(t.products, fixtures.delete_requests(t.products), t.orders, t.donations, t.team_inventory)
    sold = {r["product_id"] for df in (t.orders, t.donations, t.team_inventory) for r in rows(df.select("product_id"))}
    asked = {r["id"] for r in rows(t.products) if not r["is_active"]}
    assert {r["product_id"]: r["deleted"] for r in rows(out["results"])} == {p: p not in sold for p in asked}
    assert asked - sold and asked & sold
    assert {r["id"] for r in rows(out["products"])} == {r["id"] for r in rows(t.products)} - (asked - sold)


@pytest.fixture
def batches(spark):
    t = fixtures.load_tables(spark, SF_SMALL)
    return inventory.inventory_events(t.orders, t.donations)


def _files(store, name):
    return {b: sorted(glob.glob(folder.removeprefix("file:") + "/*.parquet")) for b, folder in store.buckets(name).items()}


def test_upsert_writes_touched_buckets_only(spark, tmp_path, batches):
    store = TableStore.create(spark, str(tmp_path / "store"))
    state = inventory.StoredInventory(store, buckets=16)
    assert state.read() is None
    first, later = batches.filter("product_id % 2 = 0"), batches.filter("product_id = 3 AND team_id = 4")
    assert state.upsert(first) == list(range(16))
    files = _files(store, "inventory")
    later = spark.createDataFrame([(4, 3, 5, "donation", "0", ts(10_000_000), "e1"), (4, 3, 2, "purchase", "e2", ts(10_000_001), "e2")], later.schema)
    touched = state.upsert(later)
    assert len(touched) == 1
    now = _files(store, "inventory")
    assert all(now[b] == files[b] and files[b] for b in files if b not in touched)
    assert now[touched[0]] != files[touched[0]]
    got = {(r["team_id"], r["product_id"]): r for r in rows(state.read())}
    want = {(r["team_id"], r["product_id"]): r for r in rows(inventory.upsert(inventory.materialise(first), later))}
    assert got == want and got[4, 3]["quantity"] == 7 and got[4, 3]["obtained_from"] == "donation"
    # the version before is whole still, and an empty batch commits nothing
    assert state.upsert(later.limit(0)) == [] and store.version() == 2


def test_killed_upsert_leaves_the_last_version(spark, tmp_path, batches, monkeypatch):
    store = TableStore.create(spark, str(tmp_path / "store"))
    state = inventory.StoredInventory(store, buckets=4)
    state.upsert(batches.filter("product_id % 2 = 0"))
    want = sorted(map(str, rows(state.read())))
    monkeypatch.setattr(TableStore, "_list", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        state.upsert(batches.filter("product_id % 2 = 1"))
    monkeypatch.undo()
    assert sorted(map(str, rows(state.read()))) == want
    state.upsert(batches.filter("product_id % 2 = 1"))
    whole = sorted(map(str, rows(inventory.materialise(batches).select(state.read().columns))))
    assert sorted(map(str, rows(state.read()))) == whole


def test_rule_report_holds_few_counts_a_key(spark, tmp_path):
    fixtures.load_tables(spark, SF_SMALL).write_parquet(str(tmp_path / "snap"))
    df = checks.rule_violations(Tables.read_parquet(spark, str(tmp_path / "snap")))
    by_key = [x for x in _plan(df).split("\n\n") if "HashAggregate" in x and "Keys [2]: [space" in x]
    assert by_key and all(x.split("Functions [")[1].split("]")[0] <= "8" for x in by_key)


def test_many_lines_are_folded_by_as_many_tasks(spark, monkeypatch):
    want = {name: rows(df) for name, df in fixtures.load_tables(spark, SF_SMALL).items() if name in ("orders", "donations", "team_inventory")}
    monkeypatch.setattr(fixtures, "TASK_LINES", 100)
    assert fixtures.tasks(spark, SF_SMALL) > 8
    t = fixtures.load_tables(spark, SF_SMALL)
    for name, held in want.items():
        assert sorted(map(str, rows(getattr(t, name)))) == sorted(map(str, held))
    assert "hashpartitioning(l_orderkey#" in _plan(t.orders) and f", {fixtures.tasks(spark, SF_SMALL)})" in _plan(t.team_inventory)


def test_team_inventory_counts_equal_product_rows(spark):
    from coffer.operators import inventory as inv_ops

    p = (1, "p1", None, 3, "c", 9, 9, True, ts(0))
    t = make_tables(spark, products=[p, p, (2, "p2", "d", 4, "c", 9, 9, True, ts(0))],
                    team_inventory=[("a", 7, 1, 2, "purchase", "o1", ts(0)), ("b", 7, 1, 3, "donation", "0", ts(1)), ("c", 7, 2, 5, "purchase", "o2", ts(2)),
                                    ("d", 7, 2, 0, "purchase", "o3", ts(3)), ("e", 7, 3, 1, "purchase", "o4", ts(3))])
    df = inv_ops.team_inventory(t)
    assert [(r["team_id"], r["product_id"], r["total_quantity"], r["entries_count"]) for r in rows(df)] == [(7, 1, 10, 2), (7, 2, 5, 1)]
    # the products' texts aren't part of the entries' groups
    assert "Keys [2]: [team_id" in _plan(df)
