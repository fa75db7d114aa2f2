"""Mapping of the driver's test tables onto the logical tables and request logs.

Every expression is integer or IEEE-double arithmetic that Spark and DuckDB
evaluate alike. The mapping only reshapes rows into the logical schemas; the
work of each query (aggregation, admission, folds) is done by the operators
and jobs on top of it. ``team_inventory`` is the one derived table: it is the
inventory materialisation job (``coffer.plans.inventory``) run over the
mapped orders and donations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.plans import inventory as inventory_job
from coffer.plans.running import has_hot_key
from coffer.sources.tables import Tables

BASE_TS = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"

# Ledger type of each event type, and the role/team rules.
EVENT_TO_LEDGER_TYPE = {
    "signup": "earn",
    "purchase": "purchase",
    "click": "donation_sent",
    "view": "donation_received",
    "error": "admin_adjustment",
}
ORDER_STATUS_OF = {"F": "verified", "O": "pending", "P": "cancelled"}


_SCANS: dict[tuple[str, str, str], DataFrame] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read once per session (the read resolves its schema eagerly)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SCANS:
        _SCANS[key] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return _SCANS[key]


def _spread(df: DataFrame) -> DataFrame:
    """Spread a fact scan that yields fewer splits than the session has cores.

    A single-row-group file is read by one task however many cores there are;
    a round-robin repartition of such a (necessarily small) input lets the
    joins above it use every core. Inputs with at least one split per core,
    as every large table has, are left as they are (no extra shuffle).
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Lines that a task joins or folds, on average, where there are many.
TASK_LINES = 500_000
_ROWS: dict[tuple[str, str], int] = {}


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """As many tasks as the store lines ask for, so that a task's share doesn't grow with them; None where the session's cores
    do. The lines are counted from the files' footers, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROWS:
        _ROWS[key] = _t(spark, sf_dir, "lineitem").count()
    n = -(-_ROWS[key] // TASK_LINES)
    return n if n > spark.sparkContext.defaultParallelism else None


_SLOTS: dict[tuple[str, str], int] = {}


def slots(spark: SparkSession, sf_dir: str) -> int:
    """Over how many slots the events of a (team, product) are dealt: one unless a product is hot among the store lines (their keys are
    scanned once per session, where the lines ask for tasks)."""
    key, n = (spark.sparkContext.applicationId, sf_dir), tasks(spark, sf_dir)
    if n and key not in _SLOTS:
        _SLOTS[key] = inventory_job.SLOTS if has_hot_key(_t(spark, sf_dir, "lineitem"), ("l_partkey",), n) else 1
    return _SLOTS[key] if n else inventory_job.SLOTS


def _after_base(unit: str, amount: str) -> Column:
    return F.expr(f"timestampadd({unit}, {amount}, {BASE_TS})")


def _case(column: Column, mapping: dict[str, str]) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(
        k.cast("bigint").alias("id"),
        F.col("c_name").alias("username"),
        F.when(k == 0, "admin").when(k % 40 == 7, "team_leader").otherwise("participant").alias("role"),
        F.when((k == 0) | (k % 10 == 9), F.lit(None).cast("bigint"))
        .otherwise(F.col("c_nationkey").cast("bigint")).alias("team_id"),
        F.floor("c_acctbal").cast("bigint").alias("balance"),
        _after_base("MINUTE", "c_custkey % 1000").alias("created_at"),
    )


def teams(spark: SparkSession, sf_dir: str, users_df: DataFrame | None = None) -> DataFrame:
    u = users_df if users_df is not None else users(spark, sf_dir)
    leaders = (u.filter(F.col("role") == "team_leader")
               .groupBy("team_id").agg(F.min("id").alias("first_leader")))
    n = _t(spark, sf_dir, "nation")
    return (n.join(leaders, n.n_nationkey == leaders.team_id, "left")
            .select(
                F.col("n_nationkey").cast("bigint").alias("id"),
                F.col("n_name").alias("name"),
                F.when(F.col("n_nationkey") % 5 != 0, F.col("first_leader")).alias("leader_id"),
                _after_base("HOUR", "n_nationkey").alias("created_at"),
            ))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return _t(spark, sf_dir, "part").select(
        k.cast("bigint").alias("id"),
        F.col("p_name").alias("name"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("description"),
        F.floor(F.col("p_retailprice") / 10).cast("bigint").alias("price"),
        F.col("p_type").alias("category"),
        F.when(size % 7 == 0, F.lit(0)).when(k % 97 == 5, F.lit(None)).otherwise(size)
        .cast("bigint").alias("stock_quantity"),
        size.cast("bigint").alias("initial_stock"),
        (k % 11 != 0).alias("is_active"),
        _after_base("MINUTE", "p_partkey % 500").alias("created_at"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _spread(_t(spark, sf_dir, "events"))
    eid = F.col("event_id")
    v = F.floor(F.col("value") * 10).cast("bigint")
    typ = _case(F.col("event_type"), EVENT_TO_LEDGER_TYPE)
    typed = e.select(eid, "user_id", "ts", typ.alias("type"), v.alias("v"))
    amount = (F.when(F.col("type") == "earn", F.col("v"))
              .when(F.col("type").isin("purchase", "donation_sent"), -F.col("v"))
              .when(F.col("type") == "donation_received", F.lit(0))
              .otherwise(F.when(eid % 2 == 0, F.col("v")).otherwise(-F.col("v"))))
    description = F.when(F.col("type") == "earn",
                         F.concat(F.lit("Redeemed code: RC"), (eid % 1000).cast("string"))).otherwise(
        F.concat(F.when(eid % 20 == 0, F.lit("Test ")).otherwise(F.lit("")),
                 F.col("type"), F.lit(" "), eid.cast("string")))
    return typed.select(
        eid.cast("bigint").alias("id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("type"),
        amount.cast("bigint").alias("amount"),
        description.alias("description"),
        F.when(F.col("type") != "earn", eid.cast("bigint")).alias("reference_id"),
        F.col("ts").alias("created_at"),
    )


def _line_price() -> Column:
    return F.floor("l_extendedprice").cast("bigint")


def _line_id(price: Column | None = None) -> Column:
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("-", *parts, (_line_price() if price is None else price).cast("string"))


def _store_lines(spark: SparkSession, sf_dir: str, users_df: DataFrame | None = None, products_df: DataFrame | None = None) -> DataFrame:
    """lineitem ⋈ orders, one row per line with the composite text id; with the buyers' teams and the products' prices if given.

    These meet the orders and the lines before the join, so that the long text ids move no more than once.
    """
    n = tasks(spark, sf_dir)
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate",
        _line_price().alias("l_price"),
        (F.floor(F.col("l_quantity") / 10) + 1).cast("bigint").alias("l_units"))
    od = _t(spark, sf_dir, "orders")
    more = []
    if users_df is not None:
        od = od.join(users_df.select(F.col("id").alias("u_id"), F.col("team_id").alias("u_team")), F.col("o_custkey") == F.col("u_id"))
        more.append("u_team")
    if products_df is not None:
        p = products_df.select(F.col("id").alias("p_id"), "price")
        li = (li.repartition(n, "l_partkey") if n else li).join(p, F.col("l_partkey") == F.col("p_id"))
        more.append("price")
    li, od = (li.repartition(n, "l_orderkey"), od.repartition(n, "o_orderkey")) if n else (_spread(li), od)
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _line_id(F.col("l_price")).alias("id"),
        F.col("o_custkey").cast("bigint").alias("user_id"),
        F.col("l_partkey").cast("bigint").alias("product_id"),
        F.col("l_suppkey").cast("bigint").alias("supplier_id"),
        F.col("l_units").alias("quantity"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("o_orderstatus").alias("orderstatus"),
        F.col("o_orderpriority").alias("orderpriority"),
        F.col("l_shipdate").alias("created_at"),
        *more,
    )


def shop_orders(spark: SparkSession, sf_dir: str, users_df: DataFrame, products_df: DataFrame) -> DataFrame:
    buyers = users_df.filter(F.col("team_id").isNotNull())
    lines = _store_lines(spark, sf_dir, buyers, products_df).filter(F.col("returnflag") != "R")
    status = _case(F.col("orderstatus"), ORDER_STATUS_OF)
    return lines.select("id", "user_id", F.col("u_team").alias("team_id"), "product_id", "quantity",
                        (F.col("price") * F.col("quantity")).alias("total_price"),
                        status.alias("status"), (status == "verified").alias("verified"), "created_at")


def donations(spark: SparkSession, sf_dir: str, users_df: DataFrame, products_df: DataFrame) -> DataFrame:
    lines = _store_lines(spark, sf_dir, users_df, products_df).filter(F.col("returnflag") == "R")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.col("s_nationkey").cast("bigint").alias("recipient_team_id"))
    leaders = (users_df.filter(F.col("role") == "team_leader").groupBy("team_id")
               .agg(F.min("id").alias("recipient_id")).withColumnRenamed("team_id", "r_team"))
    d = (lines.withColumnRenamed("u_team", "donor_team_id").join(s, lines.supplier_id == s.s_suppkey)
         .filter(F.col("recipient_team_id") != F.col("donor_team_id")))
    d = d.join(leaders, d.recipient_team_id == leaders.r_team, "left")
    return d.select(
        "id", F.col("user_id").alias("donor_id"), "recipient_id", "donor_team_id", "recipient_team_id",
        "product_id", (F.col("price") * F.col("quantity")).alias("amount"), "quantity",
        F.when(F.col("linenumber") == 1, F.lit("")).otherwise(F.col("orderpriority")).alias("message"),
        "created_at",
    )


def money_codes(transactions_df: DataFrame) -> DataFrame:
    earn = transactions_df.filter(F.col("type") == "earn").select(
        (F.col("id") % 1000).alias("n"), "user_id", "created_at")
    used = F.col("n") % 7 == 0
    return earn.groupBy("n").agg(F.min("user_id").alias("first_user"), F.min("created_at").alias("first_at")).select(
        F.col("n").alias("id"),
        F.concat(F.lit("RC"), F.col("n").cast("string")).alias("code"),
        (F.lit(100) + (F.col("n") % 50) * 10).cast("bigint").alias("amount"),
        F.when(used, F.col("first_user")).alias("used_by"),
        F.when(used, F.col("first_at")).alias("used_at"),
        F.col("first_at").alias("created_at"),
    )


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    u = users(spark, sf_dir)
    p = products(spark, sf_dir)
    tx = transactions(spark, sf_dir)
    o = shop_orders(spark, sf_dir, u, p)
    d = donations(spark, sf_dir, u, p)
    inv = inventory_job.materialise(inventory_job.inventory_events(o, d), tasks(spark, sf_dir), slots(spark, sf_dir))
    return Tables(users=u, teams=teams(spark, sf_dir, u), products=p, orders=o, transactions=tx,
                  money_codes=money_codes(tx), team_inventory=inv, donations=d)


# --- request logs ------------------------------------------------------------

def redemption_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    return e.select(
        F.col("event_id").cast("bigint").alias("request_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.concat(F.lit("RC"), (F.col("event_id") % 1000).cast("string")).alias("code"),
        F.col("ts").alias("requested_at"),
    )


def store_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _store_lines(spark, sf_dir)
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("s_team"))
    donate = F.col("returnflag") == "R"
    return lines.join(s, lines.supplier_id == s.s_suppkey).select(
        F.col("id").alias("request_id"), "user_id",
        F.when(donate, "donate").otherwise("purchase").alias("kind"),
        F.when(donate, F.col("s_team")).alias("recipient_team_id"),
        "product_id", "quantity",
        F.when(F.col("linenumber") == 1, F.lit("")).otherwise(F.col("orderpriority")).alias("message"),
        F.col("created_at").alias("requested_at"),
    )


def stock_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return e.select(
        F.col("event_id").cast("bigint").alias("request_id"),
        F.col("user_id").cast("bigint").alias("product_id"),
        F.when(F.col("event_id") % 4 == 0, "set").otherwise("adjust").alias("type"),
        ((F.col("event_id") % 41) - 15).cast("bigint").alias("adjustment"),
        F.col("ts").alias("requested_at"),
    )


def leader_requests(spark: SparkSession, sf_dir: str, users_df: DataFrame) -> DataFrame:
    e = _t(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    u = users_df.select(F.col("id").alias("u_id"), "team_id")
    return e.join(u, e.user_id == u.u_id, "left").select(
        F.col("event_id").cast("bigint").alias("request_id"),
        F.col("user_id").cast("bigint").alias("leader_id"),
        "team_id",
        F.col("ts").alias("requested_at"),
    )


def product_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product edits: of every 13th part by its own row, and of the products that 'signup' events name, with blank fields, bad
    prices and stocks, and several edits of one product."""
    p = _t(spark, sf_dir, "part").filter(F.col("p_partkey") % 13 == 0)
    own = p.select(
        F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.col("p_type").alias("category"),
        (F.floor(F.col("p_retailprice") / 10) + 1).cast("bigint").alias("price"),
        F.when(F.col("p_size") % 2 == 0, F.lit(None)).otherwise(F.col("p_size")).cast("bigint").alias("stock_quantity"),
        F.lit(0).cast("bigint").alias("request_id"), F.expr(BASE_TS).alias("edited_at"))
    k = F.col("event_id").cast("bigint")
    later = _t(spark, sf_dir, "events").filter(F.col("event_type") == "signup").select(
        F.col("user_id").cast("bigint").alias("id"), F.when(k % 23 == 1, F.lit("")).otherwise(F.concat(F.lit("edited "), (k % 50).cast("string"))).alias("name"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.lit("text")).alias("description"), F.when(k % 4 == 0, F.lit("")).otherwise(F.lit("goods")).alias("category"),
        (k % 90 - 5).alias("price"), F.when(k % 2 == 0, k % 60 - 4).alias("stock_quantity"), k.alias("request_id"), F.col("ts").alias("edited_at"))
    return own.unionByName(later)


def new_user_snapshot(users_df: DataFrame) -> DataFrame:
    return users_df.withColumn("balance", F.col("balance") + ((F.col("id") % 3) - 1) * 50)


#: Rule-breaking values mixed into every table for the checks: of each table, the columns that are replaced, as SQL.
DAMAGE = {
    "users": {
        "username": "CASE WHEN id % 90 = 6 THEN 'dup' WHEN id % 110 = 8 THEN NULL ELSE username END",
        "role": "CASE WHEN id % 50 = 3 THEN 'x' WHEN id % 130 = 9 THEN NULL ELSE role END",
        "team_id": "CASE WHEN id % 60 = 4 THEN 999 ELSE team_id END"},
    "teams": {
        "name": "CASE WHEN id % 12 = 5 THEN NULL WHEN id % 9 = 2 THEN 'same' ELSE name END",
        "leader_id": "CASE WHEN id % 7 = 3 THEN -1 - id ELSE leader_id END"},
    "products": {
        "name": "CASE WHEN id % 70 = 11 THEN NULL ELSE name END",
        "price": "CASE WHEN id % 80 = 13 THEN NULL ELSE price END"},
    "orders": {
        "user_id": "CASE WHEN user_id % 50 = 1 THEN NULL WHEN user_id % 50 = 2 THEN -user_id ELSE user_id END",
        "team_id": "CASE WHEN product_id % 90 = 17 THEN 998 WHEN product_id % 90 = 18 THEN NULL ELSE team_id END",
        "product_id": "CASE WHEN product_id % 60 = 7 THEN -product_id WHEN product_id % 60 = 9 THEN NULL ELSE product_id END",
        "total_price": "CASE WHEN product_id % 75 = 19 THEN NULL ELSE total_price END",
        "status": "CASE WHEN product_id % 40 = 21 THEN 'lost' ELSE status END"},
    "transactions": {
        "user_id": "CASE WHEN id % 500 = 7 THEN -1 - user_id WHEN id % 500 = 8 THEN NULL ELSE user_id END",
        "type": "CASE WHEN id % 400 = 9 THEN 'gift' WHEN id % 600 = 13 THEN NULL ELSE type END",
        "amount": "CASE WHEN id % 300 = 11 THEN NULL ELSE amount END"},
    "money_codes": {
        "code": "CASE WHEN id % 45 = 4 THEN 'RC0' WHEN id % 50 = 6 THEN NULL ELSE code END",
        "amount": "CASE WHEN id % 55 = 8 THEN NULL ELSE amount END",
        "used_by": "CASE WHEN id % 35 = 9 THEN -5 ELSE used_by END"},
    "team_inventory": {
        "team_id": "CASE WHEN product_id % 85 = 5 THEN 997 WHEN product_id % 85 = 6 THEN NULL ELSE team_id END",
        "product_id": "CASE WHEN product_id % 65 = 3 THEN -product_id WHEN product_id % 65 = 4 THEN NULL ELSE product_id END",
        "quantity": "CASE WHEN product_id % 95 = 7 THEN NULL ELSE quantity END",
        "obtained_from": "CASE WHEN product_id % 105 = 8 THEN 'found' WHEN product_id % 115 = 9 THEN NULL ELSE obtained_from END"},
    "donations": {
        "donor_id": "CASE WHEN product_id % 45 = 2 THEN -1 - donor_id WHEN product_id % 45 = 1 THEN NULL ELSE donor_id END",
        "recipient_id": "CASE WHEN product_id % 55 = 3 THEN -3 ELSE recipient_id END",
        "donor_team_id": "CASE WHEN product_id % 65 = 4 THEN 996 WHEN product_id % 115 = 14 THEN NULL ELSE donor_team_id END",
        "recipient_team_id": "CASE WHEN product_id % 75 = 6 THEN 995 WHEN product_id % 75 = 7 THEN NULL ELSE recipient_team_id END",
        "product_id": "CASE WHEN product_id % 85 = 8 THEN -product_id WHEN product_id % 85 = 9 THEN NULL ELSE product_id END",
        "amount": "CASE WHEN product_id % 95 = 10 THEN NULL ELSE amount END",
        "quantity": "CASE WHEN product_id % 105 = 12 THEN NULL ELSE quantity END"},
}


def damaged(t: Tables) -> Tables:
    """The tables with rows that break every rule of the checks mixed in (``DAMAGE``)."""
    return t.with_(**{name: getattr(t, name).select(*[F.expr(by[c]).alias(c) if c in by else F.col(c) for c in getattr(t, name).columns])
                      for name, by in DAMAGE.items()})


def with_testers(t: Tables) -> Tables:
    """The tables with one user in 37 named as test users are; one in 41 has a name that only looks so."""
    i = F.col("id")
    name = (F.when(i % 37 == 5, F.concat(F.lit("test_"), i.cast("string"))).when(i % 41 == 6, F.concat(F.lit("Test_"), i.cast("string")))
            .when(i % 43 == 7, F.lit("test")).otherwise(F.col("username")))
    return t.with_(users=t.users.withColumn("username", name))


def with_unsold(t: Tables) -> Tables:
    """The tables without the orders, donations and inventory of every third product, bar one trace of some: products that may go."""
    pid = F.col("product_id")
    return t.with_(orders=t.orders.filter((pid % 3 != 1) | (pid % 5 == 0)), donations=t.donations.filter((pid % 3 != 1) | (pid % 7 == 0)),
                   team_inventory=t.team_inventory.filter((pid % 3 != 1) | (pid % 13 == 0)))


def verify_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order verifications: every store line whose line status is 'F' (fulfilled)."""
    li = _t(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "F")
    return li.select(_line_id().alias("order_id"))


def code_generation_requests(money_codes_df: DataFrame) -> DataFrame:
    """One replacement code per used code, of the same amount, asked for when it was used."""
    used = money_codes_df.filter(F.col("used_by").isNotNull())
    return used.select(F.col("id").alias("request_id"), "amount", F.lit(1).alias("quantity"),
                       F.col("used_at").alias("requested_at"))


def team_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team names to insert if absent: every nation and every region name."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    r = _t(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return n.unionByName(r)


def product_create_requests(products_df: DataFrame) -> DataFrame:
    """Every product row read as a create request (name, price, stock)."""
    return products_df.select("id", "name", "price", "stock_quantity")


def delete_requests(products_df: DataFrame) -> DataFrame:
    """Deletion of every inactive product."""
    return products_df.filter(~F.col("is_active")).select(F.col("id").alias("product_id"))


def user_delete_requests(users_df: DataFrame) -> DataFrame:
    """A bulk delete request for every user (the guard decides who may go)."""
    return users_df.select(F.col("id").alias("user_id"))


def user_requests(spark: SparkSession, sf_dir: str, users_df: DataFrame) -> DataFrame:
    """User creates and edits: every 'click' event. One in 25 creates a user; the rest edit the event's user, some with a new
    name, another team, an unknown team or role, or without a name."""
    e = _t(spark, sf_dir, "events").filter(F.col("event_type") == "click").withColumn("k", F.col("event_id").cast("bigint"))
    u = users_df.select(F.col("id").alias("u_id"), F.col("username").alias("u_name"), F.col("team_id").alias("u_team"))
    j = e.join(u, e.user_id == u.u_id, "left")
    k = F.col("k")
    create = k % 25 == 0
    name = (F.when(k % 41 == 3, F.lit("")).when(create, F.concat(F.lit("new"), (k % 1000).cast("string")))
            .when(k % 10 == 1, F.concat(F.lit("alias"), (k % 130).cast("string"))).otherwise(F.coalesce("u_name", F.lit("nobody"))))
    role = F.when(k % 67 == 5, "owner").when(k % 3 == 0, "team_leader").when(k % 97 == 2, "admin").otherwise("participant")
    team = (F.when(k % 83 == 1, F.lit(999)).when(k % 11 == 4, F.lit(None)).when(k % 4 == 1, k % 25).otherwise(F.col("u_team")))
    return j.select(k.alias("request_id"), F.when(~create, F.col("user_id").cast("bigint")).alias("user_id"), name.alias("username"), role.alias("role"),
                    team.cast("bigint").alias("team_id"), F.when(k % 4 == 2, k % 500 - 50).cast("bigint").alias("balance"), F.col("ts").alias("requested_at"))


def toggle_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product switches: every 'purchase' event, of the product with the user's number; some without a value."""
    e = _t(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    k = F.col("event_id")
    return e.select(k.cast("bigint").alias("request_id"), F.col("user_id").cast("bigint").alias("product_id"),
                    F.when(k % 17 != 0, k % 3 != 0).alias("is_active"), F.col("ts").alias("requested_at"))
