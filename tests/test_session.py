import glob
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from trialkit import session


def shuffle_files(spark):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
    return {f for folder in top.split(",") for f in glob.glob(f"{folder}/**/blockmgr-*/*/shuffle_*", recursive=True)}


@pytest.mark.parametrize("store", [session.cut, session.settle])
def test_stored_steps_leave_no_shuffle_files(spark, store):
    before = shuffle_files(spark)
    counts = spark.range(0, 1000, 1, 4).repartition(5).groupBy((F.col("id") % 7).alias("k")).count()
    stored = store(counts)
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:  # they are removed in the background
        time.sleep(0.2)
    assert not left
    assert {(r["k"], r["count"]) for r in stored.collect()} == {(k, len(range(k, 1000, 7))) for k in range(7)}
    assert {(r["k"], r["count"]) for r in counts.collect()} == {(k, len(range(k, 1000, 7))) for k in range(7)}  # the frame can be run again


def test_cut_leaves_the_setting_alone(spark):
    before = spark.conf.get(session._CLEANUP, "false")
    session.cut(spark.range(3).withColumn("id2", F.col("id")).selectExpr("id", "id2 AS id"))  # equal names stay apart
    assert spark.conf.get(session._CLEANUP, "false") == before
