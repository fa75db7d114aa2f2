"""Session helpers: one place for the configuration the library relies on."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "coffer") -> SparkSession:
    """Session used by tests and the bench. On a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COFFER_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir`` (the cluster's shared folder). Only a
    local-mode session with no setting gets a scratch folder of its own; on a
    cluster a machine-local folder would be lost with its executor, so the
    setting is required there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this job")
    path = tempfile.mkdtemp(prefix="coffer-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str, default: str | None = None):
    held = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, held)


def shuffles_dropped(spark: SparkSession):
    """Inside, a query's shuffle files go when it ends, not when the driver happens to collect its garbage.

    For jobs that write each step: what a step has written is read from its table, and a lost task's exchange is run again.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true", "false")


def exchanges_of(spark: SparkSession, n: int):
    """Inside, the exchanges that joins and groups of a query ask for have ``n`` partitions."""
    return _setting(spark, "spark.sql.shuffle.partitions", str(n))


def materialize(df, name: str, **options: str):
    """Write ``df`` as a parquet table (with the writer's ``options``) under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but computes the plan once (a
    reliable RDD checkpoint runs a second job to write what the first one
    computed) and leaves a table any executor can read after a failure.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_dealt(df, name: str, key: str, n: int):
    """As ``materialize``, in ``n`` buckets by ``key``: whatever groups or joins the table's rows by it reads them where they lie.

    While ``df`` is written, its own exchanges have ``n`` partitions too, so that a task's rows belong to few buckets.
    """
    spark, path, table = df.sparkSession, scratch_path(df.sparkSession, name), f"coffer_{uuid.uuid4().hex}"
    with exchanges_of(spark, n):
        df.write.format("parquet").options(path=path, compression="zstd").bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved here: the name goes, the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


class RoundTable:
    """The tables that an iterative job writes, one a round, under one folder: read singly, or all rounds by one scan."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.rounds = spark, scratch_path(spark, name), 0

    def write(self, df):
        """Write the next round's table and read it back (cuts the lineage, as ``materialize``)."""
        path = f"{self.path}/round={self.rounds}"
        df.write.option("compression", "zstd").parquet(path)
        self.rounds += 1
        return self.spark.read.parquet(path)

    def all(self):
        """The rows of all rounds (at least one must have been written)."""
        return self.spark.read.parquet(self.path).drop("round")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``coffer`` importable in Python workers (grouped pandas functions run there).

    On a cluster this is what ``--py-files`` does; here the package folder is
    zipped once per application and added with ``addPyFile``, which copies it
    to every executor.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import shutil

    pkg = os.path.dirname(os.path.abspath(__file__))
    stage = tempfile.mkdtemp(prefix="coffer-pkg-")
    shutil.copytree(pkg, os.path.join(stage, "coffer"), ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(stage, "coffer"), "zip", stage, "coffer")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
