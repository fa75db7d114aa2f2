"""Activity feeds and ledger detail.

Feed for every viewer: a team member sees the team's newest 20 ledger rows,
an admin or a user without a team sees their own newest 10. The team feed is
computed once per team and then joined to the team's viewers (not once per
viewer), from each user's newest rows only (see ``activity_feed``).
``row_number() <= k`` per key plans as a WindowGroupLimit:
each map task keeps only its k newest rows per key before the shuffle, so a
team with a third of the ledger still ships k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coffer.functions import scalars as fx
from coffer.schemas import FEED_SIZE_PERSONAL, FEED_SIZE_TEAM, LEDGER_SAMPLE_SIZE
from coffer.sources.tables import Tables


def _newest():
    return (F.desc("created_at"), F.desc("id"))


def _top(df: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*_newest())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _display(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "amount_text": fx.signed_amount(F.col("amount")),
        "flow": fx.flow_class(F.col("type")),
        "created_text": fx.format_ts(F.col("created_at")),
    })


def activity_feed(t: Tables) -> DataFrame:
    """One row per (viewer, feed entry) for every user.

    First each user's newest 20 ledger rows are kept (a per-user top-k, cut
    map-side before its shuffle), and only those are joined to their authors.
    That is exact for both feeds: a team's newest 20 are among its members'
    own newest 20, and a personal feed is the first 10 of the same ranking.
    So the ledger itself is never shuffled, only at most 20 rows per user and
    map task, however skewed the ledger is.
    """
    per_user = _top(t.transactions, "user_id", max(FEED_SIZE_TEAM, FEED_SIZE_PERSONAL))
    u = t.users.select(F.col("id").alias("uid"), "username", F.col("team_id").alias("author_team_id"),
                       F.col("role").alias("author_role"))
    authored = per_user.join(u, per_user.user_id == u.uid).drop("uid")
    team_viewer = (F.col("role") != "admin") & F.col("team_id").isNotNull()
    viewers = t.users.select(F.col("id").alias("viewer_id"), "role", "team_id")

    team_feed = _top(authored.filter(F.col("author_team_id").isNotNull()).drop("rank"), "author_team_id",
                     FEED_SIZE_TEAM)
    team_rows = viewers.filter(team_viewer).join(
        team_feed, F.col("team_id") == F.col("author_team_id")).withColumn("scope", F.lit("team"))

    personal_author = (F.col("author_role") == "admin") | F.col("author_team_id").isNull()
    own_rows = authored.filter(personal_author & (F.col("rank") <= FEED_SIZE_PERSONAL)).withColumns(
        {"viewer_id": F.col("user_id"), "scope": F.lit("user")})

    cols = ["viewer_id", "scope", F.col("rank").cast("bigint").alias("rank"), "id", "user_id", "username",
            "type", "amount", "description", "reference_id", "created_at"]
    return _display(team_rows.select(*cols).unionByName(own_rows.select(*cols)))


def ledger_detail(t: Tables) -> DataFrame:
    """Ledger rows of users in a team with the team name: by team name, newest first."""
    return _detail(t, t.transactions)


def _detail(t: Tables, ledger: DataFrame) -> DataFrame:
    u = t.users.select(F.col("id").alias("uid"), "team_id", "username")
    tm = t.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    j = ledger.join(u, ledger.user_id == u.uid).join(tm, "team_id")
    return j.select("team_name", "team_id", "user_id", "username", "id", "type", "amount", "description",
                    "created_at").orderBy(F.asc("team_name"), *_newest())


def ledger_sample(t: Tables) -> DataFrame:
    """The first 20 rows of the ordered detail listing (a top-k: TakeOrderedAndProject).

    All of them are among the newest 20 of their users, so the ledger is cut to these before it is joined.
    """
    w = Window.partitionBy("user_id").orderBy(*_newest())
    newest = t.transactions.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= LEDGER_SAMPLE_SIZE).drop("_rank")
    return _detail(t, newest).limit(LEDGER_SAMPLE_SIZE)
