"""Leader jobs: sync (D13, X2) and the assignment fold.

Assignment requests ``(request_id, team_id, leader_id, requested_at)`` are
applied in order ``(requested_at, request_id)``. One request does, in turn:
every team_leader of the team becomes participant (and, as the trigger does,
a demoted user is cleared from any ``teams.leader_id``); the team's leader_id
becomes the new leader; the new leader's role becomes team_leader.

The sequential fold has a closed form, so it runs as grouped max/min
aggregates and joins, with no per-team or per-user sort:

* a user's final role: if the user's latest naming is at or after the latest
  request for the user's own team, team_leader; else, if there was such a
  request and the user was a leader before it (named earlier, or a leader
  from the start), participant; else unchanged.
* a team's final leader: the leader of its latest request, or the stored
  leader if it has none; cleared when that user was demoted afterwards, i.e.
  when a request for the user's own team came later than the moment the
  user became this team's leader (its request, or for a stored leader: the
  start if a leader from the start, else the user's first naming).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_leaders(users: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams with a team_leader user get the lowest such id; others keep theirs.

    Returns the four columns of the application's table function:
    team_id, team_name, leader_id, leader_name.
    """
    first = (users.filter((F.col("role") == "team_leader") & F.col("team_id").isNotNull())
             .groupBy("team_id").agg(F.min("id").alias("first_leader")))
    t = teams.join(first, teams.id == first.team_id, "left").select(
        F.col("id").alias("team_id"), F.col("name").alias("team_name"),
        F.coalesce(F.col("first_leader"), F.col("leader_id")).alias("leader_id"))
    names = users.select(F.col("id").alias("uid"), F.col("username").alias("leader_name"))
    return t.join(names, t.leader_id == names.uid, "left").select(
        "team_id", "team_name", "leader_id", "leader_name").orderBy("team_id")


def assign_leaders(users: DataFrame, teams: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Apply a log of leader assignments; returns new ``users`` and ``teams``."""
    r = requests.filter(F.col("team_id").isNotNull() & F.col("leader_id").isNotNull()).select(
        "team_id", "leader_id", F.struct("requested_at", "request_id").alias("k"))
    per_team = r.groupBy("team_id").agg(F.max("k").alias("team_last"),
                                         F.max_by("leader_id", "k").alias("new_leader"))
    per_user = r.groupBy(F.col("leader_id").alias("uid")).agg(F.max("k").alias("named_last"),
                                                              F.min("k").alias("named_first"))

    # users
    tl = per_team.select(F.col("team_id").alias("own_team"), F.col("team_last").alias("own_team_last"))
    u = (users.join(per_user, users.id == per_user.uid, "left")
         .join(tl, users.team_id == tl.own_team, "left"))
    named_last, own_last = F.col("named_last"), F.col("own_team_last")
    role = (F.when(named_last.isNotNull() & (own_last.isNull() | (named_last >= own_last)), F.lit("team_leader"))
            .when(own_last.isNotNull() & (named_last.isNotNull() | (F.col("role") == "team_leader")),
                  F.lit("participant"))
            .otherwise(F.col("role")))
    new_users = u.select(*[role.alias("role") if c == "role" else F.col(c) for c in users.columns])

    # teams
    cand = users.select(F.col("id").alias("cid"), F.col("role").alias("c_role"), F.col("team_id").alias("c_team"))
    cu = per_user.select(F.col("uid").alias("cuid"), F.col("named_first").alias("c_first"))
    ct = per_team.select(F.col("team_id").alias("ct_team"), F.col("team_last").alias("c_team_last"))
    t = teams.join(per_team, teams.id == per_team.team_id, "left")
    t = t.withColumn("cand", F.when(F.col("team_last").isNotNull(), F.col("new_leader")).otherwise(F.col("leader_id")))
    t = (t.join(cand, t.cand == cand.cid, "left").join(cu, t.cand == cu.cuid, "left")
         .join(ct, F.col("c_team") == ct.ct_team, "left"))
    later = F.col("c_team_last")
    cleared = later.isNotNull() & (
        F.when(F.col("team_last").isNotNull(), later > F.col("team_last"))
        .when(F.col("c_role") == "team_leader", F.lit(True))
        .otherwise(F.col("c_first").isNotNull() & (later > F.col("c_first"))))
    leader = F.when(F.coalesce(cleared, F.lit(False)), F.lit(None).cast("bigint")).otherwise(F.col("cand"))
    new_teams = t.select(*[leader.alias("leader_id") if c == "leader_id" else teams[c] for c in teams.columns])
    return {"users": new_users, "teams": new_teams}
