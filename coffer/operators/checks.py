"""Validation and audit jobs (V1-V9).

Parquet enforces none of the constraints the application's database does, so
each becomes a set-based check: one pass of ``count_if`` per table for NOT
NULL, ``isin`` filters for domains, grouped counts for uniqueness and anti
joins for foreign keys. Each returns one row per rule (or per offending key),
never the offending rows of a whole table through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.schemas import DOMAINS, FOREIGN_KEYS, NOT_NULL, UNIQUE_KEYS
from coffer.sources.tables import Tables

# Status texts of the leader report.
LEADER_MISSING = "❌ No Leader"
LEADER_MISMATCH = "⚠️ Leader role mismatch"
LEADER_OK = "✅ OK"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_not_null(t: Tables) -> DataFrame:
    """(table, column, null_count) for every required column; one scan per table."""
    parts = []
    for table, cols in NOT_NULL.items():
        df = getattr(t, table)
        counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in cols])
        stacked = counts.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in cols])).alias("s"))
        parts.append(stacked.select(F.lit(table).alias("table_name"), "s.column_name", "s.null_count"))
    return _union(parts)


def check_domain(t: Tables) -> DataFrame:
    """(table, column, bad_count) of values outside the allowed list (NULL passes, as in CHECK)."""
    parts = []
    for (table, col), allowed in DOMAINS.items():
        df = getattr(t, table)
        bad = F.count_if(F.col(col).isNotNull() & ~F.col(col).isin(*allowed)).cast("bigint")
        parts.append(df.agg(bad.alias("bad_count")).select(
            F.lit(table).alias("table_name"), F.lit(col).alias("column_name"), "bad_count"))
    return _union(parts)


def check_unique(t: Tables) -> DataFrame:
    """Duplicated keys: (table, key columns, key value, count) for every key seen more than once (a key with a NULL passes)."""
    parts = []
    for table, cols in UNIQUE_KEYS.items():
        df = getattr(t, table).dropna(subset=list(cols))
        dup = df.groupBy(*cols).agg(F.count(F.lit(1)).cast("bigint").alias("dup_count")).filter("dup_count > 1")
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
        parts.append(dup.select(F.lit(table).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"),
                                key.alias("key_value"), "dup_count"))
    return _union(parts)


def _rules(kinds: tuple[str, ...]) -> list[tuple[str, str, str, str | None]]:
    """(rule, table, columns, parent) of every rule of these kinds."""
    made = {
        "not_null": [(table, c, None) for table, cols in NOT_NULL.items() for c in cols],
        "domain": [(table, c, None) for table, c in DOMAINS],
        "unique": [(table, ",".join(cols), None) for table, cols in UNIQUE_KEYS.items()],
        "foreign_key": list(FOREIGN_KEYS),
    }
    return [(kind, *rule) for kind in kinds for rule in made[kind]]


def rule_violations(t: Tables, kinds: tuple[str, ...] = ("not_null", "domain", "unique", "foreign_key")) -> DataFrame:
    """V1-V4 as one report: (rule, table, columns, parent table, violations), a row for every rule, also an unbroken one.

    Rows are counted for NOT NULL, domains and foreign keys, repeated keys for uniqueness. Each table is read once: a row gives
    its own id (where another table refers to it), its references, its unique keys and the rules that it breaks by itself, all as
    (space, key, slot): a slot is a rule's number among the few of its space, so a group holds few counts however many rules there are.
    These are counted by (space, key) in the map tasks, so a key of a third of all rows is one row a task, and
    after one exchange a reference meets its parent's id as a row of the same group: no join and no list of ids.
    """
    rules = _rules(kinds)
    own, broken = -1, -1
    wanted = {parent for kind, _, _, parent in rules if kind == "foreign_key"}
    # the space of a parent's ids is its table's number, that of a unique key follows them
    space = {name: i for i, (name, _) in enumerate(t.items())}
    slot = {i: sum(kind == "foreign_key" and parent == rules[i][3] for kind, _, _, parent in rules[:i]) if rules[i][0] == "foreign_key" else 0
            for i in range(len(rules))}
    stacked = []
    for table, df in t.items():
        def entry(at: int, key, slot: int, when):
            return F.when(when, F.struct(F.lit(at).alias("space"), key.cast("string").alias("key"), F.lit(slot).alias("slot")))

        entries = [entry(space[table], F.col("id"), own, F.col("id").isNotNull())] if table in wanted else []
        for i, (kind, of, cols, parent) in enumerate(rules):
            if of != table:
                continue
            if kind == "not_null":
                entries.append(entry(broken, F.lit(i), 0, F.col(cols).isNull()))
            elif kind == "domain":
                entries.append(entry(broken, F.lit(i), 0, F.col(cols).isNotNull() & ~F.col(cols).isin(*DOMAINS[table, cols])))
            elif kind == "foreign_key":
                entries.append(entry(space[parent], F.col(cols), slot[i], F.col(cols).isNotNull()))
            else:
                # as JSON, so that no two keys are written alike; a key with a null passes
                names = cols.split(",")
                whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in names])
                entries.append(entry(len(space) + i, F.to_json(F.struct(*names)), 0, whole))
        if entries:
            stacked.append(df.select(F.inline(F.array_compact(F.array(*entries)))))
    by_key = _union(stacked).groupBy("space", "key").agg(
        F.count_if(F.col("slot") == own).alias("owners"),
        *[F.count_if(F.col("slot") == j).alias(f"s{j}") for j in range(max(slot.values()) + 1)])
    counts = []
    for i, (kind, _, _, parent) in enumerate(rules):
        n = F.col(f"s{slot[i]}")
        if kind == "foreign_key":
            counts.append(F.when((F.col("space") == space[parent]) & (F.col("owners") == 0), n))
        elif kind == "unique":
            counts.append(F.when((F.col("space") == len(space) + i) & (n > 1), 1))
        else:
            counts.append(F.when((F.col("space") == broken) & (F.col("key") == str(i)), n))
    totals = by_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"n{i}") for i, c in enumerate(counts)])
    named = [F.struct(F.lit(kind).alias("rule"), F.lit(table).alias("table_name"), F.lit(cols).alias("column_names"),
                      F.lit(parent).cast("string").alias("parent_table"), F.col(f"n{i}").alias("violations"))
             for i, (kind, table, cols, parent) in enumerate(rules)]
    return totals.select(F.inline(F.array(*named)))


def check_foreign_keys(t: Tables) -> DataFrame:
    """Orphans per edge: child rows whose non-NULL reference has no parent row; each table is read once (``rule_violations``)."""
    return rule_violations(t, ("foreign_key",)).select("table_name", "column_names", "parent_table", "violations").toDF(
        "child_table", "column_name", "parent_table", "orphan_count")


def leader_status(t: Tables) -> DataFrame:
    """Each team's leader with a status: none, role mismatch, or OK (a NULL role passes)."""
    u = t.users.select(F.col("id").alias("uid"), F.col("username").alias("leader_name"),
                       F.col("role").alias("leader_role"))
    j = t.teams.join(u, t.teams.leader_id == u.uid, "left")
    status = (F.when(F.col("leader_id").isNull(), LEADER_MISSING)
              .when(F.col("leader_role") != "team_leader", LEADER_MISMATCH).otherwise(LEADER_OK))
    return j.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"), "leader_id", "leader_name",
                    "leader_role", status.alias("status")).orderBy("team_id")


def duplicate_leaders(t: Tables) -> DataFrame:
    """Teams with more than one team_leader user; names joined by ', ' in name order."""
    g = t.users.filter(F.col("role") == "team_leader").groupBy("team_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("leader_count"),
        F.array_join(F.sort_array(F.collect_list("username")), ", ").alias("leaders"))
    return g.filter(F.col("leader_count") > 1)


def guard_product_requests(requests: DataFrame) -> DataFrame:
    """Product create requests with the first failing rule as reason, in the handler's order.

    Name required (a blank is one); price must be a positive number; stock must be given and not
    negative (0 is taken, see Q15).
    """
    name_missing = F.col("name").isNull() | (F.col("name") == "")
    reason = (F.when(name_missing, "name_required")
              .when(F.col("price").isNull() | (F.col("price") <= 0), "price_not_positive")
              .when(F.col("stock_quantity").isNull() | (F.col("stock_quantity") < 0), "stock_negative_or_missing"))
    return requests.select("id", "name", "price", "stock_quantity", reason.alias("reject_reason"),
                           reason.isNull().alias("accepted"))


def double_redemptions(t: Tables) -> DataFrame:
    """Codes that appear in more than one 'earn' ledger row (a race the handler leaves open)."""
    earn = t.transactions.filter(F.col("type") == "earn").select(
        F.regexp_extract("description", r"^Redeemed code: (.+)$", 1).alias("code"), "user_id", "amount")
    g = earn.filter(F.col("code") != "").groupBy("code").agg(
        F.count(F.lit(1)).cast("bigint").alias("redemptions"),
        F.count_distinct("user_id").cast("bigint").alias("users"),
        F.sum("amount").cast("bigint").alias("total_amount"))
    return g.filter(F.col("redemptions") > 1)
