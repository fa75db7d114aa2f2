import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", os.environ.get("COFFER_TEST_TZ", "UTC"))
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="coffer-test-ckpt-"))
         .config("spark.sql.ansi.enabled", os.environ.get("COFFER_TEST_ANSI", "true"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df):
    return [r.asDict() for r in df.collect()]
