"""Structured Streaming twins of the batch jobs (ST1-ST3).

* ST1 live team totals: each micro-batch of the ledger adds its sums per team to the totals of the version before; the
  ranking of the totals is one more table of the version.
* ST2 first redemption wins: a code's first request in (time, id) order takes it, as in the batch job; the codes taken so far are
  an append-only table.
* ST3 stock level and active flag: the batch job's fold, from the stock and flags that the version before left.

All three are ``foreachBatch`` queries whose state and results are committed together (``folds.LogFold``, ``TableStore``); order,
lateness and replay are described there. The source's ``maxFilesPerTrigger`` (or a Kafka source's ``maxOffsetsPerTrigger``)
bounds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.operators import rankings
from coffer.plans.redeem import redeem_codes
from coffer.plans.stock import adjust_stock
from coffer.session import materialize, scratch_path
from coffer.sources.commits import TableStore
from coffer.streaming.folds import LogFold

ORDER_DELAY_SECONDS = 3600

# --- plumbing ---------------------------------------------------------------------


def _slices(df: DataFrame, time_col: str, pieces: int) -> list[DataFrame]:
    """Cut a log into ``pieces`` consecutive time ranges (one small aggregate for the bounds); rows without a time come first."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {time_col})")
    bounds = df.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    if bounds.lo is None:
        return [df]
    span = bounds.hi - bounds.lo + 1
    piece = F.coalesce(F.floor((micros - F.lit(bounds.lo)) * pieces / F.lit(span)).cast("int"), F.lit(0))
    return [df.filter(piece == i) for i in range(pieces)]


def feed(spark: SparkSession, parts: Iterable[DataFrame], name: str, sink) -> None:
    """Append ``parts`` one by one to a file source and let a ``foreachBatch`` query consume each with ``availableNow``.

    Every start goes on from the checkpoint, as after a restart of a long-running query.
    """
    src, ck = scratch_path(spark, f"{name}-src"), scratch_path(spark, f"{name}-ck")
    schema = None
    for part in parts:
        if schema is None:
            schema = part.schema
            part.limit(0).write.parquet(src)  # the folder exists before the first start
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()


# --- ST1 ------------------------------------------------------------------------------

SUMS = ("earned", "spent", "donated")


def team_increments(ledger: DataFrame, users: DataFrame) -> DataFrame:
    """``team_id, earned, spent, donated`` of some ledger rows, summed per user before they meet the users."""
    members = users.filter(F.col("team_id").isNotNull()).select(F.col("id").alias("user_id"), "team_id")
    return rankings.ledger_by_user(ledger).join(members, "user_id").groupBy("team_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS])


def totals_fold(spark: SparkSession, path: str, ledger: DataFrame, users: DataFrame, teams: DataFrame) -> LogFold:
    """ST1: ``totals`` has a row per team, ``ranking`` the ranked teams; sums have no order, so nothing waits."""

    def step(store: TableStore, rows: DataFrame):
        new = store.read("totals").unionByName(team_increments(rows, users)).groupBy("team_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS])
        new = materialize(new, "st1-totals")
        return {"totals": new, "ranking": rankings.ranked(team_board(new, users, teams))}, {}

    none = team_increments(ledger.limit(0), users)
    return LogFold(spark, path, ledger, None, 0, step, {"totals": none, "ranking": rankings.ranked(team_board(none, users, teams))})


def team_board(totals: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """Totals of all teams, also of those without members or ledger rows."""
    counts = users.filter(F.col("team_id").isNotNull()).groupBy(F.col("team_id").alias("ct")).agg(
        F.count(F.lit(1)).alias("member_count"))
    j = (teams.select("id", F.col("name").alias("team_name"))
         .join(totals, F.col("id") == totals.team_id, "left").join(counts, F.col("id") == counts.ct, "left"))
    z = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("member_count", *SUMS)}
    return j.select("id", "team_name", z["member_count"].alias("member_count"),
                    z["earned"].alias("total_earned"), z["spent"].alias("total_spent"),
                    z["donated"].alias("total_donated"), (z["earned"] - z["spent"]).alias("current_balance"))


def stream_totals(spark: SparkSession, ledger: DataFrame, users: DataFrame, teams: DataFrame, pieces: int = 4) -> TableStore:
    """The whole ledger through ST1, slice by slice."""
    fold = totals_fold(spark, scratch_path(spark, "st1"), ledger, users, teams)
    feed(spark, _slices(ledger, "created_at", pieces), "st1", fold.batch)
    return fold.close(spark)


def run_team_totals(spark: SparkSession, ledger: DataFrame, users: DataFrame, teams: DataFrame, pieces: int = 4) -> DataFrame:
    """Final per-team totals of ST1 (batch twin: A1 sums)."""
    return team_board(stream_totals(spark, ledger, users, teams, pieces).read("totals"), users, teams)


# --- ST2 ------------------------------------------------------------------------------


def redeem_fold(spark: SparkSession, path: str, requests: DataFrame, users: DataFrame, codes: DataFrame, delay: int = ORDER_DELAY_SECONDS) -> LogFold:
    """ST2: ``results`` has a row per request, ``taken`` one per code that a request took.

    The winner of a code among the requests of a batch is a grouped minimum (one row per code and map task), so a code that most requests
    name costs no more than others. A winner is final: no request before it can still be applied.
    """

    def step(store: TableStore, ready: DataFrame):
        gone = store.read("taken").select(F.col("code_id").alias("taken_id"), F.col("user_id").alias("taker"))
        j = codes.join(gone, codes.id == gone.taken_id, "left")
        now = j.select(*[F.coalesce("used_by", "taker").alias(c) if c == "used_by" else codes[c] for c in codes.columns])
        results = materialize(redeem_codes(users, now, ready)["results"], "st2-results")
        return {}, {"results": results, "taken": results.filter("accepted").select("code_id", "user_id")}

    none = redeem_codes(users, codes, requests.limit(0))["results"]
    return LogFold(spark, path, requests, "requested_at", delay, step, {"results": none, "taken": none.select("code_id", "user_id")})


def run_redeem(spark: SparkSession, requests: DataFrame, users: DataFrame, codes: DataFrame, pieces: int = 4) -> DataFrame:
    """Run ST2 over a redemption log; returns the per-request results (batch twin: D3 results)."""
    fold = redeem_fold(spark, scratch_path(spark, "st2"), requests, users, codes)
    feed(spark, _slices(requests, "requested_at", pieces), "st2", fold.batch)
    return fold.close(spark).read("results")


# --- ST3 ------------------------------------------------------------------------------


def stock_fold(spark: SparkSession, path: str, requests: DataFrame, products: DataFrame, delay: int = ORDER_DELAY_SECONDS) -> LogFold:
    """ST3: ``results`` has a row per request with the flag after it, ``stock`` the stock and flag of every product that a request named."""

    def step(store: TableStore, ready: DataFrame):
        held = store.read("stock").select(F.col("id").alias("held_id"), F.col("stock_quantity").alias("held_stock"), F.col("is_active").alias("held_active"))
        j = products.join(held, products.id == held.held_id, "left")
        # a product that was named keeps what the fold left it, also a null
        since = {"stock_quantity": "held_stock", "is_active": "held_active"}
        now = j.select(*[F.when(F.col("held_id").isNotNull(), F.col(since[c])).otherwise(products[c]).alias(c) if c in since else products[c]
                         for c in products.columns])
        ready = materialize(ready, "st3-ready")
        run = adjust_stock(now, ready, flags=True)
        named = ready.select(F.col("product_id").alias("id")).unionByName(held.select(F.col("held_id").alias("id"))).distinct()
        stock = run.products.join(named, "id", "left_semi").select("id", "stock_quantity", "is_active")
        return {"stock": stock}, {"results": run.results}

    none = adjust_stock(products, requests.limit(0), flags=True)
    return LogFold(spark, path, requests, "requested_at", delay, step,
                   {"results": none.results, "stock": products.select("id", "stock_quantity", "is_active").limit(0)})


def run_stock(spark: SparkSession, requests: DataFrame, products: DataFrame, pieces: int = 4) -> DataFrame:
    """Run ST3 over an adjustment log; returns the per-request results (batch twin: D8 results)."""
    fold = stock_fold(spark, scratch_path(spark, "st3"), requests, products)
    feed(spark, _slices(requests, "requested_at", pieces), "st3", fold.batch)
    return fold.close(spark).read("results")
