"""D3: money-code redemption over a request log, first request wins.

Requests ``(request_id, user_id, code, requested_at)`` in order
``(requested_at, request_id)``. Checks in the handler's order: a code is
given; the user is a team_leader or admin; the code exists and is unused.
The first eligible request for an initially unused code takes it; later ones
find it used. The winner per code is a grouped ``min`` of the order key
(partial aggregation, so a code requested by a third of all requests costs
one row per map task), joined back to the requests.

Outputs: per-request results, the money_codes snapshot with the new
redemptions, the 'earn' ledger rows, and users with credited balances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ledger text of a redemption and the roles allowed to redeem.
REDEEM_TEXT = "Redeemed code: "
REDEEM_ROLES = ("team_leader", "admin")


def redeem_codes(users: DataFrame, codes: DataFrame, requests: DataFrame,
                 processed_at: Column | None = None) -> dict[str, DataFrame]:
    """``processed_at`` stamps used_at and the ledger rows (the handler's "now"); it defaults to the
    request time, so a rerun of the same log gives the same tables."""
    stamp = processed_at if processed_at is not None else F.col("requested_at")
    u = users.select(F.col("id").alias("uid"), "role")
    r = requests.join(u, requests.user_id == u.uid, "left").withColumn(
        "k", F.struct("requested_at", "request_id"))
    given = F.col("code").isNotNull() & (F.col("code") != "")
    role_ok = F.coalesce(F.col("role").isin(*REDEEM_ROLES), F.lit(False))
    r = r.withColumn("eligible", given & role_ok)
    first = r.filter("eligible").groupBy(F.col("code").alias("f_code")).agg(F.min("k").alias("first_k"))
    free = codes.filter(F.col("used_by").isNull()).select(
        F.col("code").alias("c_code"), F.col("id").alias("code_id"), F.col("amount").alias("code_amount"))
    j = (r.join(first, r.code == first.f_code, "left").join(free, r.code == free.c_code, "left"))
    accepted = F.col("eligible") & F.col("code_id").isNotNull() & (F.col("k") == F.col("first_k"))
    reason = (F.when(~given, "code_required").when(~role_ok, "forbidden")
              .when(~F.coalesce(accepted, F.lit(False)), "invalid_or_used"))
    j = j.withColumn("stamp", stamp)
    results = j.select(
        "request_id", "user_id", "code", "requested_at",
        F.coalesce(accepted, F.lit(False)).alias("accepted"), reason.alias("reason"),
        F.when(accepted, F.col("code_amount")).alias("amount"), F.when(accepted, F.col("code_id")).alias("code_id"),
        "stamp")

    won = results.filter("accepted")
    ledger = won.select(
        F.col("request_id").alias("id"), "user_id", F.lit("earn").alias("type"), F.col("amount").cast("bigint"),
        F.concat(F.lit(REDEEM_TEXT), F.col("code")).alias("description"),
        F.lit(None).cast("bigint").alias("reference_id"), F.col("stamp").alias("created_at"))

    taken = won.select(F.col("code_id").alias("tid"), F.col("user_id").alias("new_by"),
                       F.col("stamp").alias("new_at"))
    cj = codes.join(taken, codes.id == taken.tid, "left")
    new_codes = cj.select(*[
        F.coalesce(F.col("used_by"), F.col("new_by")).alias("used_by") if c == "used_by" else
        F.coalesce(F.col("used_at"), F.col("new_at")).alias("used_at") if c == "used_at" else codes[c]
        for c in codes.columns])

    credit = won.groupBy(F.col("user_id").alias("cid")).agg(F.sum("amount").alias("credit"))
    uj = users.join(credit, users.id == credit.cid, "left")
    new_users = uj.select(*[
        (F.col("balance") + F.coalesce(F.col("credit"), F.lit(0))).cast("bigint").alias("balance")
        if c == "balance" else users[c] for c in users.columns])
    return {"results": results.drop("stamp"), "money_codes": new_codes, "ledger": ledger, "users": new_users}
