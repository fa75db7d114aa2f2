"""Folds of request logs over micro-batches, with the state in committed table versions (ST1-ST3).

A micro-batch is folded by the batch job's own plan, so nothing runs row by row in Python and a key with most of the
requests is spread as the batch job spreads it. What the fold knows between micro-batches is a version of a
``TableStore``: batch n reads version n and commits version n + 1 with its results, the new state, the requests that still wait and
the clock, all or none. A batch that is replayed after its commit changes nothing; one that is replayed after a crash in
mid-write starts from the last whole version.

Requests may arrive out of order by up to ``delay`` seconds: a request waits until the newest one seen is that much later, and is
then applied in (time, id) order. One that arrives after its time has been passed is kept in the table ``late`` and applied
nowhere; ``close`` ends a log that is complete: it applies what still waits and refuses to hide late requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.session import materialize
from coffer.sources.commits import TableStore

#: (store, requests to apply) -> (tables to replace, tables to append to)
Step = Callable[[TableStore, DataFrame], tuple[dict[str, DataFrame], dict[str, DataFrame]]]
_END = "9999-12-31 00:00:00"


class LogFold:
    """A fold of requests with the columns of ``log`` and the time in ``time_col`` (None where their order doesn't matter, so none waits or is late); ``state`` are its
    tables before any."""

    def __init__(self, spark: SparkSession, path: str, log: DataFrame, time_col: str | None, delay: int, step: Step, state: dict[str, DataFrame]):
        self.path, self.time_col, self.delay, self.step = path, time_col, delay, step
        none = log.limit(0)
        clock = spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS seen, CAST(NULL AS TIMESTAMP_NTZ) AS applied")
        TableStore.create(spark, path, {"waiting": none, "late": none, "clock": clock, **state})

    def batch(self, arrived: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` sink."""
        self._apply(arrived.sparkSession, arrived, batch_id + 1, False)

    def close(self, spark: SparkSession) -> TableStore:
        store = TableStore(spark, self.path)
        self._apply(spark, store.read("waiting").limit(0), store.version() + 1, True)
        late = store.read("late").count()
        if late:
            raise RuntimeError(f"{late} requests arrived later than the delay allows; the result would not be whole")
        return store

    def _apply(self, spark: SparkSession, arrived: DataFrame, version: int, end: bool) -> None:
        store = TableStore(spark, self.path)
        if version <= store.version():
            return
        clock = store.read("clock").first()
        arrived = materialize(arrived, "fold-arrived")
        t = F.col(self.time_col) if self.time_col else F.lit(None).cast("timestamp_ntz")
        at = lambda when: F.lit(None if when is None else str(when)).cast("timestamp_ntz")
        seen = F.greatest(F.max(t), at(clock.seen))
        till = F.to_timestamp_ntz(F.lit(_END)) if end else F.expr(f"seen - INTERVAL {self.delay} SECONDS")
        now = arrived.agg(seen.alias("seen")).select("seen", F.greatest(till, at(clock.applied)).alias("applied")).first()
        passed = lambda when: F.coalesce(t <= at(when), F.lit(False))
        late = arrived.filter(passed(clock.applied))
        known = arrived.filter(~passed(clock.applied)).unionByName(store.read("waiting"))
        # a request without a time comes first of all, so it doesn't wait
        ready = known.filter(passed(now.applied) | t.isNull())
        replace, append = self.step(store, ready)
        tick = spark.createDataFrame([(now.seen, now.applied)], "seen timestamp_ntz, applied timestamp_ntz")
        store.commit(version=version, replace={"waiting": known.filter(~passed(now.applied) & t.isNotNull()), "clock": tick, **replace},
                     append={"late": late, **append})
