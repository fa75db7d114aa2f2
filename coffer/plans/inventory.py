"""Team inventory as an accumulating upsert, set-based.

One row per (team, product). Each purchase or received donation adds its
quantity; the row keeps reference and time of the latest event. A purchase
upsert leaves ``obtained_from`` as it was, a donation upsert sets it to
'donation' (reference 0), so the final source is 'donation' as soon as any
donation touched the key. Events are ordered by (created_at, event id).

The grouping is a hash aggregate with map-side partial aggregation: a hot
(team, product) key sends one partial row per map task, never its raw rows.
Where most keys are held by few events that saves nothing and a task's groups
are as many as its events: given a number of ``tasks``, the events are dealt
over them by key and one of ``SLOTS`` slots, then the slots' rows by key, so a
task's groups are bounded and a hot key is still many tasks' work. One slot
(one move less) does where the caller knows that no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.sources.commits import TableStore

DONATION_REFERENCE = "0"
SLOTS = 16


def inventory_events(orders: DataFrame, donations: DataFrame) -> DataFrame:
    """Purchases and received donations as one event log of inventory deltas."""
    bought = orders.select(
        "team_id", "product_id", "quantity", F.lit("purchase").alias("kind"),
        F.col("id").alias("reference_id"), "created_at", F.col("id").alias("event_id"))
    given = donations.select(
        F.col("recipient_team_id").alias("team_id"), "product_id", "quantity",
        F.lit("donation").alias("kind"), F.lit(DONATION_REFERENCE).alias("reference_id"),
        "created_at", F.col("id").alias("event_id"))
    return bought.unionByName(given)


def _inventory_id(team: Column, product: Column) -> Column:
    return F.concat_ws(":", team.cast("string"), product.cast("string"))


def _fold(events: DataFrame, tasks: int | None = None, slots: int = SLOTS) -> DataFrame:
    """Per key the quantity, whether a donation touched it, and reference and time of its last event.

    The last event's (time, id) is what moves; the reference goes beside it only where it isn't the id.
    """
    def folded(by: list[str]) -> DataFrame:
        return events.groupBy(*by).agg(
            F.sum("quantity").alias("quantity"), F.max("last").alias("last"), F.bool_or("any_donation").alias("any_donation"))

    key = ["team_id", "product_id"]
    own = F.col("reference_id").eqNullSafe(F.col("event_id"))
    events = events.select(*key, "quantity", (F.col("kind") == "donation").alias("any_donation"), F.struct(
        "created_at", "event_id", own.alias("own"), F.when(~own, F.col("reference_id")).alias("reference")).alias("last"))
    if tasks and slots > 1:
        events = events.withColumn("slot", F.pmod(F.xxhash64("last.event_id"), F.lit(slots))).repartition(tasks, *key, "slot")
        events = folded([*key, "slot"]).drop("slot")
    if tasks:
        events = events.repartition(tasks, *key)
    return folded(key).select(
        *key, "quantity", F.when(F.col("last.own"), F.col("last.event_id")).otherwise(F.col("last.reference")).alias("reference_id"),
        F.col("last.created_at").alias("created_at"), "any_donation")


def materialise(events: DataFrame, tasks: int | None = None, slots: int = SLOTS) -> DataFrame:
    """Inventory state from the whole event log."""
    g = _fold(events, tasks, slots)
    return g.select(
        _inventory_id(F.col("team_id"), F.col("product_id")).alias("id"),
        "team_id", "product_id", F.col("quantity").cast("bigint").alias("quantity"),
        F.when(F.col("any_donation"), "donation").otherwise("purchase").alias("obtained_from"),
        "reference_id", "created_at",
    )


def upsert(prior: DataFrame, events: DataFrame, tasks: int | None = None) -> DataFrame:
    """New inventory snapshot = prior snapshot + a batch of later events.

    Full outer join on the unique key (team, product): keys only in the prior
    keep their row, new keys are inserted, matched keys add up.
    """
    g = _fold(events, tasks).alias("n")
    p = prior.alias("p")
    j = p.join(g, (F.col("p.team_id") == F.col("n.team_id")) & (F.col("p.product_id") == F.col("n.product_id")),
               "full_outer")
    matched_new = F.col("n.team_id").isNotNull()
    team = F.coalesce(F.col("p.team_id"), F.col("n.team_id"))
    product = F.coalesce(F.col("p.product_id"), F.col("n.product_id"))
    return j.select(
        F.coalesce(F.col("p.id"), _inventory_id(team, product)).alias("id"),
        team.alias("team_id"), product.alias("product_id"),
        (F.coalesce(F.col("p.quantity"), F.lit(0)) + F.coalesce(F.col("n.quantity"), F.lit(0)))
        .cast("bigint").alias("quantity"),
        F.when(matched_new & F.col("n.any_donation"), "donation")
        .when(F.col("p.team_id").isNotNull(), F.col("p.obtained_from"))
        .otherwise("purchase").alias("obtained_from"),
        F.when(matched_new, F.col("n.reference_id")).otherwise(F.col("p.reference_id")).alias("reference_id"),
        F.when(matched_new, F.col("n.created_at")).otherwise(F.col("p.created_at")).alias("created_at"),
    )


class StoredInventory:
    """The inventory as a table of a ``TableStore`` in buckets by (team, product).

    ``upsert`` reads and writes only the buckets that its events touch, as the next version; a killed run leaves the last one.
    The number of buckets is fixed for a table: choose it so that a bucket fits a task, and batches touch few of them.
    """

    def __init__(self, store: TableStore, name: str = "inventory", buckets: int = 64, tasks: int | None = None):
        self.store, self.name, self.n, self.tasks = store, name, buckets, tasks

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("team_id").cast("bigint"), F.col("product_id").cast("bigint")), F.lit(self.n)).cast("int")

    def upsert(self, events: DataFrame) -> list[int]:
        """Add a batch of events (later than those before); the buckets written again."""
        # at most as many rows as there are buckets come to the driver
        touched = sorted(r[0] for r in events.select(self._bucket().alias("b")).distinct().collect())
        if not touched:
            return []
        prior = self.store.read_buckets(self.name, touched)
        new = materialise(events, self.tasks) if prior is None else upsert(prior, events, self.tasks)
        self.store.commit_buckets(self.name, new.withColumn("bucket", self._bucket()), "bucket", touched)
        return touched

    def read(self) -> DataFrame | None:
        """The state; None before the first upsert."""
        return self.store.read_buckets(self.name)
