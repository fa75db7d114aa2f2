"""Plan shapes that the scale design relies on (checked with the public explain output)."""

import contextlib
import io

from conftest import SF_SMALL

from coffer.operators import feed, rankings
from coffer.sources import fixtures


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_feed_limits_per_key_before_the_shuffle(spark):
    plan = _plan(feed.activity_feed(fixtures.load_tables(spark, SF_SMALL)))
    tree = plan.split("\n\n")[0]
    # partial top-k below an exchange, final top-k above it
    assert tree.count("WindowGroupLimit") >= 4


def test_rankings_aggregate_partially_before_exchanging(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(rankings.team_rankings(fixtures.load_tables(spark, SF_SMALL)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "partial_sum" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_query_plans_a_cross_product(spark):
    from coffer.registry import QUERIES
    from oracle_sql import ORACLE

    names = sorted(k for k in ORACLE if k in QUERIES and not k.startswith("stream_"))
    offenders = []
    for name in names:
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            offenders.append(name)
    assert offenders == []


def test_inventory_of_no_hot_key_moves_its_events_once(spark):
    """And an event's id moves once, not as its reference too."""
    from coffer.plans import inventory

    rows = [(1, 7, 2, "purchase", "a", 5, "a"), (1, 7, 3, "purchase", "x", 6, "b"), (1, 7, 4, "purchase", None, 7, "c"),
            (2, 7, 1, "donation", "0", 1, "d"), (2, 7, 1, "purchase", "e", 1, "e"), (3, 7, 1, "purchase", None, None, None)]
    e = spark.createDataFrame(rows, "team_id long, product_id long, quantity long, kind string, reference_id string, at long, event_id string")
    e = e.selectExpr("* EXCEPT (at)", "CAST(timestamp_seconds(at) AS timestamp_ntz) AS created_at").repartition(2)
    want = {(1, 9, "purchase", None), (2, 2, "donation", "e"), (3, 1, "purchase", None)}
    for n, slots, moves in ((None, 16, 1), (4, 16, 2), (4, 1, 1)):
        got = inventory.materialise(e, n, slots)
        assert {(r.team_id, r.quantity, r.obtained_from, r.reference_id) for r in got.collect()} == want
        plan = _plan(inventory.materialise(e, n, slots)).split("\n\n")[0]
        assert plan.count("Exchange") - 1 == moves, plan


def test_line_ids_are_made_after_the_last_move(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixtures.load_tables(spark, SF_SMALL).orders._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert 0 < plan.index("concat_ws") < plan.index("Exchange")
