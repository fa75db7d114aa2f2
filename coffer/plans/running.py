"""Keyed running sums that stay parallel when one key holds a third of the rows.

A window ``partitionBy(key).orderBy(t)`` puts every row of a key in one task.
Here each row first gets a *chunk*: the index of its range partition under
``repartitionByRange(n, key, order...)``. Range partitioning samples the full
(key, order) tuple, so a hot key is cut into several contiguous, ordered
chunks. The running sum then has two levels:

* inside a (key, chunk) group: a window over rows of one chunk only;
* across chunks: per-(key, chunk) totals (a partial aggregate), and a window
  over those totals per key. Only a key's second and later pieces have anything
  before them, and each of these begins at one of the n - 1 boundaries between
  chunks, so fewer than n rows are joined back: that side is broadcast.

Where no key is hot, nothing is cut: ``add_hot_chunk`` moves the rows of hot keys
only, and a sum over a key without chunks is one window.

All sums of a call read the columns of its input, a written table, so the
input is scanned once for the rows and once for each key's totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coffer.session import materialize

ORDER = ("requested_at", "request_id")


def add_chunk(df: DataFrame, key: str, name: str, partitions: int, order=ORDER) -> DataFrame:
    """Tag each row with the index of its (key, order) range partition.

    The tag must be materialised (checkpoint or written) before use, so every
    later read sees the same chunks.
    """
    return df.repartitionByRange(partitions, key, *order).withColumn(name, F.spark_partition_id())


def add_hot_chunk(df: DataFrame, key: str, name: str, partitions: int, order=ORDER) -> DataFrame:
    """As ``add_chunk``, for the keys that hold more than half of a partition's share of ``df`` (fewer than 2 * ``partitions``).

    The rows of the other keys aren't moved; each of these keys is one piece, numbered -1. The result is a written table, or
    ``df`` itself, without the column, where no key is hot.
    """
    share = df.count() / (2 * partitions)
    hot = df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share).select("_hot")
    hot = materialize(hot, "hot-keys")
    if hot.isEmpty():
        return df
    is_hot = F.col(key).eqNullSafe(F.col("_hot"))
    cold = df.join(F.broadcast(hot), is_hot, "left_anti").withColumn(name, F.lit(-1))
    return materialize(cold.unionByName(add_chunk(df.join(F.broadcast(hot), is_hot, "left_semi"), key, name, partitions, order)), "hot-chunks")


#: Values that a sketch of frequent keys follows, at least; its counts err by less than 4 parts in so many.
SKETCHED = 10_000


def has_hot_key(df: DataFrame, keys: tuple[str, ...], partitions: int) -> bool:
    """Whether a key of ``df`` holds more than half of a partition's share (as in ``add_hot_chunk``), by sketches of the frequent values:
    no row is moved, and fewer than 2 * ``partitions`` values a key come to the driver."""
    most = 2 * partitions
    tops = [F.expr(f"approx_top_k({key}, {most}, {min(1_000_000, max(SKETCHED, 20 * most))})").alias(key) for key in keys]
    n, *found = df.agg(F.count(F.lit(1)).alias("_n"), *tops).first()
    return any(x["item"] is not None and x["count"] > n / most for top in found for x in top)


def exclusive_running_sums(df: DataFrame, sums: dict[tuple[str, str | None], dict[str, Column]], order=ORDER) -> DataFrame:
    """Add, per (key, chunk) and named value, the sum over earlier rows of the same key (0 for the first).

    ``df`` is a written table (or a projection of one); its chunks come from ``add_chunk`` or ``add_hot_chunk`` on the key, or on
    a key that this one refines in the same order. Without chunks (None) a key's rows are one piece, and any ``df`` will do.
    """
    out = df
    for (key, chunk), values in sums.items():
        if chunk is None:
            before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            out = out.withColumns({n: F.coalesce(F.sum(v).over(before), F.lit(0)).cast("bigint") for n, v in values.items()})
            continue
        inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        pieces = Window.partitionBy("_key").orderBy("_chunk")
        before = pieces.rowsBetween(Window.unboundedPreceding, -1)
        totals = df.filter(F.col(chunk) >= 0).groupBy(F.col(key).alias("_key"), F.col(chunk).alias("_chunk")).agg(
            *[F.sum(v).alias(f"_{n}_tot") for n, v in values.items()])
        offsets = totals.select("_key", "_chunk", (F.row_number().over(pieces) > 1).alias("_later"), *[
            F.sum(f"_{n}_tot").over(before).alias(f"_{n}_off") for n in values]).filter("_later")
        out = out.withColumns({f"_{n}_in": F.sum(v).over(inside) for n, v in values.items()})
        out = out.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("_key")) & (F.col(chunk) == F.col("_chunk")), "left")
        out = out.withColumns({n: (F.coalesce(F.col(f"_{n}_in"), F.lit(0)) + F.coalesce(F.col(f"_{n}_off"), F.lit(0))).cast("bigint")
                               for n in values})
        out = out.drop("_key", "_chunk", "_later", *[f"_{n}_in" for n in values], *[f"_{n}_off" for n in values])
    return out


def running_last(df: DataFrame, key: str, chunk: str, value: str, name: str, order=ORDER, inclusive: bool = True) -> DataFrame:
    """Add ``name``: per key, the last ``value`` that isn't null, at this row (unless not ``inclusive``) or before it (null without one).

    Two levels, as the running sums: a window inside each (key, chunk), and per key one row a chunk for what comes before.
    """
    inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = df.groupBy(F.col(key).alias("_key"), F.col(chunk).alias("_chunk")).agg(F.max_by(value, known).alias("_end"))
    carried = ends.select("_key", "_chunk", F.last("_end", ignorenulls=True).over(before).alias("_carried")).filter("_carried IS NOT NULL")
    out = df.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
    out = out.join(F.broadcast(carried), F.col(key).eqNullSafe(F.col("_key")) & (F.col(chunk) == F.col("_chunk")), "left")
    return out.withColumn(name, F.coalesce("_own", "_carried")).drop("_key", "_chunk", "_own", "_carried")
