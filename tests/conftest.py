import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from logwarden.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                        "spark.ui.showConsoleProgress": "false",
                                        # Not UTC on purpose: results must not depend on the session zone.
                                        "spark.sql.session.timeZone": "America/New_York"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_runs(spark):
    """Cut keys into tiny runs, so the split paths are taken on small data."""
    spark.conf.set("logwarden.rowsPerRun", "7")
    yield
    spark.conf.unset("logwarden.rowsPerRun")


@pytest.fixture(scope="session")
def skewed(spark):
    """Events in which one user holds a third of the rows, half of the times tie, and some users are null."""
    from pyspark.sql import functions as F

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    i = F.col("event_id")
    return ev.select(
        "event_id", "event_type", "value",
        F.when(i % 3 == 0, 1).when(i % 17 == 0, None).otherwise(F.col("user_id") % 5).cast("string").alias("user"),
        F.when(i % 10 < 5, F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")).otherwise(F.col("ts")).alias("ts"))
