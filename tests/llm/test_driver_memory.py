"""What the driver keeps of near-duplicates: records of tasks and stages, not of rows."""

import random

from strideflow.llm import near_dup
from strideflow.llm.common import planned_once


def test_small_tables_take_few_tasks(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame([(k, texts[k % 40]) for k in range(80)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table, n = near_dup.laid(docs.groupBy("text").count())
        assert n == 40 and table.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        pairs = spark.createDataFrame([(k, k + 1) for k in range(0, 60, 2)], "a long, b long").repartition(50, "a")
        found = near_dup.connected_components(pairs)
        assert {r.id: r.component for r in found.collect()} == {k + 1: k for k in range(0, 60, 2)}
        got = near_dup.near_duplicates(docs).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(k, k % 40) for k in range(80)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_setting_is_restored(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    with planned_once(spark):
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
