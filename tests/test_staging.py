"""Staged tables leave no shuffle files behind."""

import time

import pytest
from fleetcast.plans.staging import materialize
from pyspark.sql import functions as F


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in held.split("\n") if "/shuffle_" in f}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_shuffles_go_with_the_write(spark, adaptive):
    name, key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", F.col("id") % 100
    set_before, files_before = spark.conf.get(name), shuffle_files(spark)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(10_000).repartition(4, "id").groupBy(key.alias("k")).count().join(spark.range(50).hint("merge"), F.col("k") == F.col("id"))
        staged = materialize(rows)
        for _ in range(50):
            if not (left := shuffle_files(spark) - files_before):
                break
            time.sleep(0.1)
        assert not left
        assert spark.conf.get(name) == set_before
        # The plan can still run again.
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, staged.collect())) and staged.count() == 50
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
