"""File sources and sinks: the product and user CSV inputs (S1, S2), JSON results.

Both CSV readers use fixed schemas (never ``inferSchema``) so the scan is
planned without a pass over the data, and select only what they need so
Catalyst prunes unread CSV columns (the users file's password hash is never
parsed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.functions.scalars import js_default
from coffer.schemas import DEFAULT_CATEGORY, PRODUCTS_CSV, USERS_CSV

PRODUCT_COLUMNS = [f.name for f in PRODUCTS_CSV.fields]
USER_COLUMNS = ["username", "role", "team_id", "balance"]


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """Products file with a header row; an empty description becomes '' and a missing category 'item'."""
    raw = spark.read.schema(PRODUCTS_CSV).option("header", True).option("mode", "FAILFAST").csv(path)
    return raw.select(
        "name",
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        "price",
        js_default(F.col("category"), DEFAULT_CATEGORY).alias("category"),
        "stock_quantity", "initial_stock", "is_active",
    )


def read_users_csv(spark: SparkSession, path: str) -> DataFrame:
    """Users file with a header row; the password hash column is dropped on read."""
    raw = spark.read.schema(USERS_CSV).option("header", True).option("mode", "FAILFAST").csv(path)
    return raw.select(*USER_COLUMNS)


def write_products_csv(products: DataFrame, path: str) -> None:
    """Write products in the input file's 7-column layout."""
    products.select(*PRODUCT_COLUMNS).write.option("header", True).csv(path)


def write_users_csv(users: DataFrame, path: str) -> None:
    """Write users in the input file's layout; the hash column is left empty."""
    users.select("username", F.lit(None).cast("string").alias("password_hash"), "role", "team_id",
                 "balance").write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines result sink (the list endpoints' wire format), one file per partition."""
    df.write.mode("errorifexists").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read JSON lines back with a fixed schema."""
    return spark.read.schema(schema).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append new rows (ledger, orders, donations) to a table folder; earlier files stay as they are."""
    df.write.mode("append").parquet(path)
