"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.session import materialize, ship_package

#: Fixed by the task: a word is a run of characters other than these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"

__all__ = ["NON_SPACE", "SPACE", "load", "materialize", "ship_package", "text_of", "words"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE), "")
