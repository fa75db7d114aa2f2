"""Creating and editing users, with what that does to teams, leaders and the ledger.

Requests ``(request_id, user_id, username, role, team_id, balance, requested_at)`` are applied in the order
``(requested_at, request_id)``; a null ``user_id`` creates a user, any other edits a stored one. An accepted edit gives
the user its name, role and team (null: none) and, where a balance is given, that balance with a ledger row for the difference; a created user
starts with balance 0. Leaders follow the row trigger and the edit handler:

* giving a user the role team_leader in a team makes it the team's leader, and every other team_leader of the team a participant;
* a demoted user, or a leader edited into another role or out of its team, is cleared from every ``teams.leader_id``.

Refused, first reason that holds: ``username_and_role_required``, ``user_not_found``, ``invalid_role``, ``team_not_found``,
``username_taken``. A name belongs to its stored user, or else to whoever first asks for it in an otherwise sound request,
for the whole run: a name given up in a run is free in the next. Users created in a run can be edited from the next run on.

The sequential fold has a closed form. Each accepted request with role team_leader and a team is an *appointment*.

* A user's role is that of its last request, but participant if it leads a team that saw a later appointment.
* A team that saw appointments is led by the last one's user if that user's last request leaves it leader of the
  team, and else by nobody.
* A team without appointments keeps its stored leader, unless that user lost a leadership at any time: by a request
  that took it away, or by another's appointment before its own next request.

So the work is grouped maxima (partial aggregation), equi-joins against one row a user, team or name, and "the last before"
per user and per team, which is spread over tasks where one user or team has most of the requests (``plans/running``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.plans.edits import ADMIN_ADDED, ADMIN_REMOVED
from coffer.plans.numbering import dense_ids
from coffer.plans.running import ORDER, add_chunk, running_last
from coffer.schemas import ROLES
from coffer.session import materialize

LEADER, DEMOTED = "team_leader", "participant"


def _judged(users: DataFrame, teams: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests with ``reason`` (null: accepted)."""
    u = users.select(F.col("id").alias("_uid"), F.lit(True).alias("_known"))
    t = teams.select(F.col("id").alias("_tid"), F.lit(True).alias("_team"))
    r = requests.select("request_id", "user_id", "username", "role", "team_id", "balance", "requested_at")
    r = r.join(u, r.user_id == u._uid, "left").join(t, r.team_id == t._tid, "left")
    unsound = (F.when((F.coalesce("username", F.lit("")) == "") | (F.coalesce("role", F.lit("")) == ""), "username_and_role_required")
               .when(F.col("user_id").isNotNull() & F.col("_known").isNull(), "user_not_found")
               .when(~F.col("role").isin(*ROLES), "invalid_role")
               .when(F.col("team_id").isNotNull() & F.col("_team").isNull(), "team_not_found"))
    claimant = F.coalesce(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.concat(F.lit("request "), F.col("request_id").cast("string")))
    r = r.withColumn("reason", unsound).withColumn("_claimant", claimant).drop("_uid", "_tid", "_known", "_team")
    r = materialize(r, "member-requests")
    # a name's owner: one row a name
    first = r.filter("reason IS NULL").groupBy("username").agg(F.min_by("_claimant", F.struct(*ORDER)).alias("_first"))
    stored = users.select(F.col("username").alias("_name"), F.concat(F.lit("user "), F.col("id").cast("string")).alias("_stored"))
    owner = (first.join(stored.groupBy("_name").agg(F.min("_stored").alias("_stored")), first.username == F.col("_name"), "left")
             .select(F.col("username").alias("_wanted"), F.coalesce("_stored", "_first").alias("_owner")))
    j = r.join(owner, r.username == owner._wanted, "left")
    taken = F.col("reason").isNull() & (F.col("_owner") != F.col("_claimant"))
    return j.withColumn("reason", F.when(taken, "username_taken").otherwise(F.col("reason"))).drop("_wanted", "_owner", "_claimant")


def edit_users(users: DataFrame, teams: DataFrame, requests: DataFrame, partitions: int | None = None) -> dict[str, DataFrame]:
    """``results`` (every request with accepted, reason and user id), new ``users`` and ``teams``, and ``ledger`` rows."""
    n = partitions or int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = materialize(_judged(users, teams, requests), "member-judged")
    accepted = judged.filter("reason IS NULL").drop("reason")
    top = users.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    made = dense_ids(accepted.filter("user_id IS NULL").drop("user_id"), ORDER, top, "user_id", n).withColumn("made", F.lit(True))
    made = materialize(made, "member-made")
    events = accepted.filter("user_id IS NOT NULL").withColumn("made", F.lit(False)).unionByName(made)

    # each request with its user's state before it: that of the user's last request, or the stored one
    events = events.withColumn("state", F.struct("role", "team_id", F.struct(*ORDER).alias("at")))
    events = materialize(add_chunk(events, "user_id", "chunk", n), "member-events")
    s = users.select(F.col("id").alias("_uid"), F.col("role").alias("_role"), F.col("team_id").alias("_team"), F.col("balance").alias("_balance"))
    e = running_last(events, "user_id", "chunk", "state", "before", inclusive=False)
    e = running_last(e, "user_id", "chunk", "balance", "given", inclusive=False)
    e = e.join(s, e.user_id == s._uid, "left").select(
        events["*"], F.coalesce("given", "_balance").alias("held"), F.coalesce("before.role", "_role").alias("old_role"),
        F.when(F.col("before").isNull(), F.col("_team")).otherwise(F.col("before.team_id")).alias("old_team"), F.col("before.at").alias("old_at"))
    e = materialize(e, "member-states")

    # appointments, with the one before in the same team
    app = e.filter((F.col("role") == LEADER) & F.col("team_id").isNotNull()).withColumn("at", F.struct(*ORDER))
    app = materialize(add_chunk(app, "team_id", "team_chunk", n), "member-appointments")
    last_app = materialize(app.groupBy(F.col("team_id").alias("a_team")).agg(F.max("at").alias("a_at"), F.max_by("user_id", "at").alias("a_user")), "member-leaders")

    # users after all requests
    last = e.groupBy(F.col("user_id").alias("l_user")).agg(
        F.max_by(F.struct("username", "role", "team_id", F.struct(*ORDER).alias("at")), F.struct(*ORDER)).alias("last"),
        F.max_by("balance", F.when(F.col("balance").isNotNull() & ~F.col("made"), F.struct(*ORDER))).alias("l_balance"))
    fresh = made.select(F.col("user_id").alias("id"), "username", "role", "team_id", F.lit(0).cast("bigint").alias("balance"), F.col("requested_at").alias("created_at"))
    own = [c for c in users.columns]
    everyone = users.unionByName(fresh, allowMissingColumns=True)
    j = everyone.join(last, everyone.id == last.l_user, "left")
    j = j.withColumns({"n_role": F.coalesce("last.role", "role"),
                       "n_team": F.when(F.col("last").isNull(), F.col("team_id")).otherwise(F.col("last.team_id"))})
    j = j.join(last_app, j.n_team == last_app.a_team, "left")
    demoted = (F.col("n_role") == LEADER) & F.col("a_at").isNotNull() & (F.col("last.at").isNull() | (F.col("a_at") > F.col("last.at")))
    new = {"username": F.coalesce("last.username", "username"), "team_id": F.col("n_team"), "balance": F.coalesce("l_balance", "balance"),
           "role": F.when(demoted, DEMOTED).otherwise(F.col("n_role"))}
    after = materialize(j.select(*[new.get(c, F.col(c)).alias(c) for c in own], demoted.alias("_demoted")), "member-after")

    # who lost a leadership: edited away, edited to the same place after another's appointment there, or demoted at the end
    same = (F.col("role") == F.col("old_role")) & F.col("team_id").eqNullSafe(F.col("old_team"))
    moved = e.filter((F.col("old_role") == LEADER) & ~same & (F.col("old_team").isNotNull() | (F.col("role") != LEADER))).select("user_id")
    again = running_last(app, "team_id", "team_chunk", "at", "prior", inclusive=False)
    again = again.filter((F.col("old_role") == LEADER) & F.col("old_team").eqNullSafe(F.col("team_id")) & F.col("prior").isNotNull()
                         & ~F.col("prior").eqNullSafe(F.col("old_at"))).select("user_id")
    lost = moved.unionByName(again).unionByName(after.filter("_demoted").select(F.col("id").alias("user_id"))).distinct().withColumnRenamed("user_id", "lost_user")

    # teams: the last appointment's user if it still leads there, or the stored leader if it lost nothing
    t = teams.join(last_app, teams.id == last_app.a_team, "left").withColumn("_cand", F.coalesce("a_user", "leader_id"))
    lead = after.filter((F.col("role") == LEADER) & F.col("team_id").isNotNull()).select(F.col("id").alias("_lead"), F.col("team_id").alias("_lead_team"))
    t = t.join(lead, (F.col("a_user") == F.col("_lead")) & (F.col("id") == F.col("_lead_team")), "left").join(lost, F.col("_cand") == lost.lost_user, "left")
    stays = F.when(F.col("a_user").isNotNull(), F.col("_lead").isNotNull()).otherwise(F.col("lost_user").isNull())
    new_teams = t.select(*[F.when(stays, F.col("_cand")).alias(c) if c == "leader_id" else F.col(c) for c in teams.columns])

    diff = F.col("balance") - F.col("held")
    text = F.when(diff > 0, F.format_string(ADMIN_ADDED, diff)).otherwise(F.format_string(ADMIN_REMOVED, F.abs(diff)))
    ledger = e.filter(~F.col("made") & (diff != 0)).select(
        "request_id", "user_id", F.lit("admin_adjustment").alias("type"), diff.cast("bigint").alias("amount"), text.alias("description"),
        F.col("requested_at").alias("created_at"))
    ids = made.select(F.col("request_id").alias("_rid"), F.col("user_id").alias("_new"))
    results = judged.join(ids, judged.request_id == ids._rid, "left").select(
        "request_id", F.coalesce("user_id", "_new").alias("user_id"), F.col("reason").isNull().alias("accepted"), "reason")
    return {"results": results, "users": after.drop("_demoted"), "teams": new_teams, "ledger": ledger}
