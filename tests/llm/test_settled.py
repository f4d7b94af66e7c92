"""Checkpoints that remove the shuffle files behind them."""

import time

import pytest
from pyspark.sql import functions as F

from strideflow.llm.common import settled

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _files(spark) -> int:
    return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()


def test_rows_stay_and_shuffle_files_go(spark):
    before = _files(spark)
    counted = settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    until = time.monotonic() + 20
    while _files(spark) > before and time.monotonic() < until:
        time.sleep(0.2)
    assert _files(spark) <= before
    assert {r.k: r.n for r in counted.collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}
    assert counted.count() == 7  # read again after the files went


def test_clashing_names_and_empty_tables(spark):
    twice = spark.range(3).select("id", F.col("id").alias("id"))
    assert sorted(map(tuple, settled(twice).collect())) == [(0, 0), (1, 1), (2, 2)]
    assert settled(spark.range(0).groupBy("id").count()).isEmpty()


def test_setting_is_restored_also_after_a_failure(spark):
    before = spark.conf.get(KEY)
    settled(spark.range(1))
    assert spark.conf.get(KEY) == before
    with pytest.raises(Exception):
        settled(spark.range(1).select(F.raise_error(F.lit("stop"))))
    assert spark.conf.get(KEY) == before
