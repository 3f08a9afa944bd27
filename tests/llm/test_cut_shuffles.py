"""What a write shuffled goes with the write."""

import time

from pyspark.sql import functions as F

from regioscope.llm import common

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for name in files.mkString("\n").split("\n") if "/shuffle_" in name}


def test_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    spread = spark.range(200_000, numPartitions=4).groupBy((F.col("id") % 50_021).alias("k")).agg(F.collect_list("id").alias("x"))
    got = common.cut(spread.join(spark.range(60_000).select(F.col("id").alias("k")).hint("merge"), "k"))
    left, until = shuffle_files(spark) - before, time.time() + 15
    while left and time.time() < until:
        time.sleep(0.3)
        left = shuffle_files(spark) - before
    assert not left
    assert got.count() == 50_021 and spark.conf.get(CLEANUP, None) in (None, "false")
