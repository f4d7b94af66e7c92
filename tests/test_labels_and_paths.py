"""Label order, message order, and what file names and lists of files tell, signals of any length."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from strideflow.operators import timeseries, training
from strideflow.plans import catalog
from strideflow.sources import files


def test_subjects_of_file_names(spark):
    cases = [("/r/accel/data_1600_accel_phone.txt", "data", "_accel_phone.txt", "1600"), ("file:/r/Participant_3.csv", "Participant", ".csv", "3"),
             ("/r/Participant_10_b.csv", "Participant", ".csv", "10"), ("/data_1/readme.txt", "data", "_accel_phone.txt", None), ("/r/Participant_3.xlsx", "Participant", ".csv", None)]
    for path, prefix, ending, subject in cases:
        assert spark.range(1).select(files.subject_file(F.lit(path), prefix, ending)).first()[0] == subject


def test_lists_of_files_once_in_order(spark):
    lists = [spark.createDataFrame([(p,) for p in names], "path string") for names in (["b", "d", "b"], ["a", "b"], [])]
    assert [r.path for r in files.union_of_paths(*lists).collect()] == ["a", "b", "d"]


def test_labels_stand_in_the_targets_order(spark):
    rows = spark.createDataFrame([(n,) for n in ("stand", "walk", "stand", None, "other")], "activity string")
    order = training.label_order(rows, ["walk", "run", "stand"])
    assert order == ["walk", "stand"]
    assert [r[0] for r in rows.select(training.label_index(F.col("activity"), order)).collect()] == [1, 0, 1, None, None]
    assert training.label_order(rows.limit(0), ["walk"]) == [] and rows.select(training.label_index(F.col("activity"), [])).first()[0] is None


def test_messages_out_of_order_stay(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 1, 5), ("a", 2, 7), ("a", 3, 6), ("b", 0, 1), ("b", 1, None)], "session string, seq long, message_id long")
    got = [r.out_of_order for r in timeseries.out_of_order(rows).orderBy("session", "seq").collect()]
    assert got == [False, True, False, True, False, False]


def test_autocorrelation_of_short_and_long_signals(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=n)]) for i, n in enumerate((1, 12, 13, 40, 64, 150))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT vec_id, peak, lag_s FROM ({catalog.ORACLES['feat_autocorr']}) ORDER BY vec_id").fetchall()
    got = [tuple(r) for r in catalog.QUERIES["feat_autocorr"](spark, str(tmp_path)).select("vec_id", "peak", "lag_s").orderBy("vec_id").collect()]
    assert got == want and [r[1] is None for r in got] == [True, True, False, False, False, False]
