"""Set-based write jobs.

Each takes state DataFrames plus a request DataFrame and returns the new
DataFrame(s); nothing is updated in place (parquet has no MERGE here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.plans.numbering import dense_ids
from coffer.session import RoundTable
from coffer.sources.tables import Tables

# Names the reset gives to teams 1-6, ledger texts of the admin
# balance edit and of the sample ledger generator.
RESET_TEAM_NAMES = {1: "A그룹", 2: "B그룹", 3: "C그룹", 4: "D그룹", 5: "E그룹", 6: "Z그룹"}
ADMIN_ADDED = "Admin added $%d to balance"
ADMIN_REMOVED = "Admin removed $%d from balance"
SAMPLE_EARN = "Test money code for %s"
SAMPLE_DONATION = "Test donation from %s to other teams"
SAMPLE_PURCHASE = "Test purchase by %s"
SAMPLE_BASE_AMOUNT = 100000
SAMPLE_DONATION_SHARE = 0.1
SAMPLE_PURCHASE_SHARE = 0.05
SAMPLE_DONATING_TEAMS_MAX_ID = 4
# What a blank field of the product edit form stands for.
EDIT_DEFAULTS = {"description": "", "category": "item"}


def insert_if_absent(existing: DataFrame, candidates: DataFrame, key: str = "name") -> DataFrame:
    """Add candidate rows whose unique key is absent; new ids follow the current maximum.

    The new rows are numbered in key order, range by range (``numbering.dense_ids``), so a batch of any size is spread.
    """
    new = candidates.select(key).distinct().join(existing.select(key), key, "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = dense_ids(new, (key,), top).select("id", key, F.lit(True).alias("inserted"))
    return existing.select("id", key, F.lit(False).alias("inserted")).unionByName(added)


def guard_product_edits(edits: DataFrame) -> DataFrame:
    """The edits with ``reject_reason`` (null: sound): a name that is given must not be blank, the price must be above 0 and
    a stock that is given not below 0. Columns that the log doesn't have aren't checked."""
    reason = F.lit(None).cast("string")
    if "stock_quantity" in edits.columns:
        reason = F.when(F.col("stock_quantity") < 0, "stock_negative").otherwise(reason)
    if "price" in edits.columns:
        reason = F.when(F.col("price").isNull() | (F.col("price") <= 0), "price_not_positive").otherwise(reason)
    if "name" in edits.columns:
        reason = F.when(F.coalesce("name", F.lit("")) == "", "name_required").otherwise(reason)
    return edits.withColumn("reject_reason", reason)


def apply_product_edits(products: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits by id that pass ``guard_product_edits``; a missing or blank stock keeps the stock (Q27).

    As the edit form sends all its fields, a blank description becomes ``''`` and a blank category ``'item'``; columns that the
    log doesn't have stay. Edits of one product apply in the order of ``edited_at`` (and ``request_id``, where the edits
    have one): the last one counts, and of the stocks the last one given. Without either column, the larger value wins.
    is_active is never changed by an edit (Q13).
    """
    changed = [c for c in edits.columns if c in products.columns and c not in ("id", "is_active")]
    order = [c for c in ("edited_at", "request_id") if c in edits.columns]

    def last(c):
        if c in EDIT_DEFAULTS:
            value = F.when(F.coalesce(c, F.lit("")) == "", EDIT_DEFAULTS[c]).otherwise(F.col(c))
        else:
            value = F.col(c)
        return F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_value")))).getField("_value").alias(f"e_{c}")

    sound = guard_product_edits(edits).filter("reject_reason IS NULL")
    e = sound.groupBy(F.col("id").alias("e_id")).agg(*[last(c) for c in changed])
    j = products.join(e, products.id == e.e_id, "left")
    return j.select(*[F.coalesce(F.col(f"e_{c}"), products[c]).alias(c) if c in changed else products[c] for c in products.columns])


def toggle_products(products: DataFrame, requests: DataFrame) -> DataFrame:
    """Set is_active from requests (request_id, product_id, is_active); latest per product wins, a missing value
    turns the product off."""
    latest = requests.groupBy("product_id").agg(
        F.max(F.struct("requested_at", "request_id", F.coalesce("is_active", F.lit(False)).alias("on"))).getField("on").alias("new_active"))
    j = products.join(latest, products.id == latest.product_id, "left")
    return j.select(*[F.coalesce(F.col("new_active"), products[c]).alias(c) if c == "is_active" else products[c]
                      for c in products.columns])


def verify_orders(orders: DataFrame, verify_ids: DataFrame) -> DataFrame:
    """Orders listed in the requests become verified (status and flag)."""
    v = verify_ids.select(F.col("order_id").alias("vid")).distinct()
    j = orders.join(v, orders.id == v.vid, "left")
    hit = F.col("vid").isNotNull()
    cols = []
    for c in orders.columns:
        if c == "status":
            cols.append(F.when(hit, F.lit("verified")).otherwise(F.col(c)).alias(c))
        elif c == "verified":
            cols.append((hit | F.col(c)).alias(c))
        else:
            cols.append(orders[c])
    return j.select(*cols)


def balance_changes(old_users: DataFrame, new_users: DataFrame) -> DataFrame:
    """One 'admin_adjustment' ledger row per user whose balance changed, with a signed text."""
    o = old_users.select(F.col("id").alias("user_id"), F.col("balance").alias("old_balance"))
    n = new_users.select(F.col("id").alias("user_id"), F.col("balance").alias("new_balance"))
    d = o.join(n, "user_id").withColumn("amount", F.col("new_balance") - F.col("old_balance"))
    d = d.filter(F.col("amount") != 0)
    text = F.when(F.col("amount") > 0, F.format_string(ADMIN_ADDED, F.col("amount"))).otherwise(
        F.format_string(ADMIN_REMOVED, F.abs(F.col("amount"))))
    return d.select("user_id", F.lit("admin_adjustment").alias("type"), F.col("amount").cast("bigint"),
                    text.alias("description"), "old_balance", "new_balance")


def sample_ledger(users: DataFrame, teams: DataFrame) -> DataFrame:
    """Test ledger rows for every team whose leader has the team_leader role.

    earn base × team id; teams with id ≤ 4 also donate 10 %; odd ids also buy for 5 %.
    """
    leaders = users.filter(F.col("role") == "team_leader").select(F.col("id").alias("leader_id"))
    t = teams.join(leaders, "leader_id").select(F.col("id").alias("team_id"), F.col("name").alias("team_name"),
                                                 "leader_id")
    earned = F.col("team_id") * SAMPLE_BASE_AMOUNT
    rows = F.array(
        F.struct(F.lit("earn").alias("type"), earned.cast("bigint").alias("amount"),
                 F.format_string(SAMPLE_EARN, "team_name").alias("description"), F.lit(True).alias("keep")),
        F.struct(F.lit("donation_sent").alias("type"),
                 (-F.round(earned * SAMPLE_DONATION_SHARE)).cast("bigint").alias("amount"),
                 F.format_string(SAMPLE_DONATION, "team_name").alias("description"),
                 (F.col("team_id") <= SAMPLE_DONATING_TEAMS_MAX_ID).alias("keep")),
        F.struct(F.lit("purchase").alias("type"), (-F.round(earned * SAMPLE_PURCHASE_SHARE)).cast("bigint").alias("amount"),
                 F.format_string(SAMPLE_PURCHASE, "team_name").alias("description"),
                 (F.col("team_id") % 2 == 1).alias("keep")),
    )
    x = t.select("team_id", F.col("leader_id").alias("user_id"), F.explode(rows).alias("r")).filter("r.keep")
    return x.select("team_id", "user_id", "r.type", "r.amount", "r.description")


def _drawn(slots: DataFrame) -> DataFrame:
    """``slots`` (request_id, n, attempt, requested_at, ...) with ``code``: 'RC' + epoch millis + 6 base-36 characters of a
    hash of request, index and attempt."""
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', requested_at)")
    seed = F.concat_ws("-", F.col("request_id").cast("string"), F.col("n").cast("string"), F.col("attempt").cast("string"))
    h = F.conv(F.substring(F.md5(seed), 1, 12), 16, 10).cast("bigint") % F.lit(36 ** 6)
    return slots.withColumn("code", F.concat(F.lit("RC"), millis.cast("string"), F.lpad(F.lower(F.conv(h.cast("string"), 10, 36)), 6, "0")))


def code_request_results(requests: DataFrame) -> DataFrame:
    """Every request with ``accepted`` and ``reason``: an amount above 0 and a quantity of 1 or more are needed."""
    reason = (F.when(F.col("amount").isNull() | (F.col("amount") <= 0), "amount_not_positive")
              .when(F.col("quantity").isNull() | (F.col("quantity") < 1), "quantity_below_one"))
    return requests.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def generated_codes(requests: DataFrame, existing: DataFrame | None = None, draw=_drawn) -> DataFrame:
    """N codes for each accepted request (request_id, amount, quantity, requested_at), all different and none of
    ``existing``.

    The random part of the application is a hash of (request, index, attempt) here, so a rerun gives the same codes. Of equal
    draws the first by (request, index) stands; the others, and draws that exist already, are drawn again until none is left, so a
    round holds only what collided in the one before, whose codes are written tables.
    """
    ok = code_request_results(requests).filter("accepted")
    slots = ok.select("request_id", "amount", "requested_at", F.explode(F.sequence(F.lit(1), F.col("quantity").cast("int"))).alias("n"),
                      F.lit(0).alias("attempt"))
    rounds = RoundTable(requests.sparkSession, "codes")
    known = existing.select("code") if existing is not None else None
    while True:
        fresh = draw(slots)
        first = fresh.groupBy(F.col("code").alias("_code")).agg(F.min(F.struct("request_id", "n")).alias("_first"))
        fresh = fresh.join(first, fresh.code == first._code).withColumn("stands", F.struct("request_id", "n") == F.col("_first")).drop("_code", "_first")
        if known is not None:
            k = known.select(F.col("code").alias("_known")).distinct()
            fresh = fresh.join(k, fresh.code == k._known, "left").withColumn("stands", F.col("stands") & F.col("_known").isNull()).drop("_known")
        made = rounds.write(fresh)
        again = made.filter("NOT stands")
        if again.isEmpty():
            break
        done = rounds.all().filter("stands").select("code")
        known = done if existing is None else existing.select("code").unionByName(done)
        slots = again.drop("code", "stands").withColumn("attempt", F.col("attempt") + 1)
    return rounds.all().filter("stands").select("request_id", "n", "code", F.col("amount").cast("bigint").alias("amount"),
                                                F.col("requested_at").alias("created_at"))


def reset_users(users: DataFrame) -> DataFrame:
    """Only admins stay, with balance 0."""
    return users.filter(F.col("role") == "admin").withColumn("balance", F.lit(0).cast("bigint"))


def reset_teams(teams: DataFrame) -> DataFrame:
    """No team keeps a leader; teams 1-6 get the reset names."""
    name = F.col("name")
    for k in sorted(RESET_TEAM_NAMES, reverse=True):
        name = F.when(F.col("id") == k, F.lit(RESET_TEAM_NAMES[k])).otherwise(name)
    return teams.select(*[name.alias("name") if c == "name" else
                          F.lit(None).cast("bigint").alias("leader_id") if c == "leader_id" else F.col(c)
                          for c in teams.columns])


def reset_tables(t: Tables) -> dict[str, DataFrame]:
    """The whole reset. Admins stay with balance 0, teams without leaders and under the reset names; the other six tables are emptied."""
    emptied = ("products", "orders", "transactions", "money_codes", "team_inventory", "donations")
    return {"users": reset_users(t.users), "teams": reset_teams(t.teams), **{n: getattr(t, n).limit(0) for n in emptied}}


def delete_products(products: DataFrame, requests: DataFrame, orders: DataFrame, donations: DataFrame,
                    inventory: DataFrame) -> dict[str, DataFrame]:
    """Delete requested products unless an order, donation or inventory row points to it."""
    refs = (orders.select(F.col("product_id").alias("pid"))
            .unionByName(donations.select(F.col("product_id").alias("pid")))
            .unionByName(inventory.select(F.col("product_id").alias("pid"))).distinct())
    req = requests.select(F.col("product_id").alias("pid")).distinct()
    known = products.select(F.col("id").alias("pid"))
    checked = req.join(known, "pid", "left_semi").join(refs.withColumn("ref", F.lit(True)), "pid", "left")
    results = checked.select(F.col("pid").alias("product_id"),
                             F.col("ref").isNull().alias("deleted"),
                             F.when(F.col("ref").isNotNull(), F.lit("referenced")).alias("reason"))
    gone = results.filter("deleted").select(F.col("product_id").alias("pid"))
    remaining = products.join(gone, products.id == gone.pid, "left_anti")
    return {"results": results, "products": remaining}


def delete_users(users: DataFrame, transactions: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Delete requested users unless they are admins or have ledger rows (anti joins, no id list)."""
    req = requests.select(F.col("user_id").alias("rid")).distinct()
    has_rows = transactions.select(F.col("user_id").alias("rid")).distinct()
    known = users.select(F.col("id").alias("rid"), "role")
    checked = req.join(known, "rid").join(has_rows.withColumn("has_rows", F.lit(True)), "rid", "left")
    reason = F.when(F.col("role") == "admin", "admin").when(F.col("has_rows").isNotNull(), "has_transactions")
    results = checked.select(F.col("rid").alias("user_id"), reason.isNull().alias("deleted"), reason.alias("reason"))
    gone = results.filter("deleted").select(F.col("user_id").alias("gid"))
    return {"results": results, "users": users.join(gone, users.id == gone.gid, "left_anti")}
