"""The eight logical tables as one value passed to every operator."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from coffer.schemas import TABLE_SCHEMAS

# Join key each table is bucketed on: users and everything keyed by a user share one bucketing.
BUCKET_KEYS = {
    "users": "id",
    "transactions": "user_id",
    "orders": "user_id",
    "donations": "donor_id",
    "money_codes": "id",
    "products": "id",
    "teams": "id",
    "team_inventory": "team_id",
}


@dataclass(frozen=True)
class Tables:
    users: DataFrame
    teams: DataFrame
    products: DataFrame
    orders: DataFrame
    transactions: DataFrame
    money_codes: DataFrame
    team_inventory: DataFrame
    donations: DataFrame

    def with_(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    @classmethod
    def read_parquet(cls, spark: SparkSession, root: str) -> "Tables":
        """Snapshot folder with one parquet directory per table, read with fixed schemas."""
        return cls(**{
            name: spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
            for name, schema in TABLE_SCHEMAS.items()
        })

    @classmethod
    def read_catalog(cls, spark: SparkSession, database: str) -> "Tables":
        """Tables saved with ``save_bucketed`` (their bucketing is known to the planner)."""
        return cls(**{name: spark.table(f"{database}.{name}") for name in TABLE_SCHEMAS})

    def save_bucketed(self, database: str, buckets: int, mode: str = "errorifexists") -> None:
        """Save a snapshot as catalog tables bucketed (and sorted) on the key they are joined on.

        The ledger, orders and the users dimension share ``user_id``/``id``
        buckets, so the per-user ledger aggregate and its join to users read
        co-located buckets instead of shuffling either side. ``buckets`` should
        be the same for all tables (and sized so a bucket fits a task).
        """
        for name, df in self.items():
            key = BUCKET_KEYS[name]
            (df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
             .saveAsTable(f"{database}.{name}"))

    def write_parquet(self, root: str, mode: str = "errorifexists") -> None:
        """Write a new snapshot (no in-place MERGE on parquet: each state is a new folder)."""
        for name, df in self.items():
            df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")
