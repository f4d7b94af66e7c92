"""Work by slices against windows over whole sessions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.operators import decode, sliced, timeseries
from strideflow.plans import catalog


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    out, seq = [], 0
    for session, n in ((1, 900), (2, 7), (None, 300), (3, 1)):
        t = np.cumsum(rng.choice([0.0, 0.02, 0.02, 0.5], n))
        for k in range(n):
            out.append((session, seq, None if rng.random() < 0.01 else float(t[k]), rng.choice(["walk", "walk", "run", None]) if rng.random() < 0.3 else "walk", float(k)))
            seq += 1
    return spark.createDataFrame(out, "session int, seq long, t double, activity string, x double")


def values(df, *columns):
    return sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("size,cuts", [(10_000, 8), (100, 5), (5, 200)])
def test_against_whole_windows(spark, rows, size, cuts):
    cut = sliced.add_slices(rows, size=size, cuts=cuts).cache()
    assert cut.count() == rows.count() and cut.where("session = 1").select("_slice").distinct().count() > (1 if size < 900 else 0)
    assert values(sliced.runs(cut, "activity"), "seq", "run") == values(timeseries.label_runs(rows), "seq", "run")
    timed = rows.where("t is not null")
    want = values(timeseries.gap_segments(timed, 0.25), "seq", "segment", "t_segment")
    assert values(sliced.segments(sliced.add_slices(timed, size=size, cuts=cuts), 0.25), "seq", "segment", "t_segment") == want


def test_empty_rows(rows):
    none = sliced.add_slices(rows.where("false"))
    assert sliced.runs(none, "activity").count() == sliced.segments(none, 1.0).count() == 0
    with pytest.raises(ValueError):
        sliced.segments(none, 0.0)


@pytest.mark.parametrize("parts", [1, 50])
def test_contiguous_ids_in_file_order(spark, tmp_path, parts, monkeypatch):
    ids = [*["a"] * 5, *["b"] * 3, *["a"] * 4, None, None, "c", *["a"] * 300, *["d"] * 7]
    folder = str(tmp_path / "f")
    spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "ident string, x double").coalesce(1).write.option("parquet.block.size", 1024).parquet(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", before if parts == 1 else "200")
    try:
        for size in (1000, 100, 2):
            got = sliced.contiguous_sessions(sliced.file_rows(spark, folder, size), "ident").groupBy("run", "ident").agg(F.count("*"), F.min("x")).collect()
            assert sorted(map(tuple, got)) == [(1, "a", 5, 0.0), (2, "b", 3, 5.0), (3, "a", 4, 8.0), (4, None, 2, 12.0), (5, "c", 1, 14.0), (6, "a", 300, 15.0), (7, "d", 7, 315.0)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_whole_windows_only(spark, tmp_path):
    ids = [*["w1"] * 4, *["w2"] * 3, *["w1"] * 4, *["w3"] * 5, *["w4"] * 4]
    spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "global_window_id string, acc_x double").coalesce(1).write.parquet(str(tmp_path / "f"))
    got = sliced.whole_windows(sliced.file_rows(spark, str(tmp_path / "f"), 3), 4, ("acc_x",)).orderBy("run").collect()
    assert [(r.global_window_id, r.acc_x) for r in got] == [("w1", [0.0, 1.0, 2.0, 3.0]), ("w1", [7.0, 8.0, 9.0, 10.0]), ("w4", [16.0, 17.0, 18.0, 19.0])]


@pytest.mark.parametrize("cuts", [1, 7, 63])
def test_decoding_by_slices(spark, cuts):
    rng = np.random.default_rng(2)
    probs = rng.dirichlet([0.2] * 4, 600)
    probs[100], probs[200] = [1, 0, 0, 0], [np.nan, 0.5, 0.2, 0.3]
    out = [(1, k, k / 3, p.tolist()) for k, p in enumerate(probs)] + [(2, k, float(k), p.tolist()) for k, p in enumerate(probs[:5])] + [(3, k, float(k), None if k == 250 else p.tolist()) for k, p in enumerate(probs[:400])]
    rows = spark.createDataFrame(out, "session int, seq long, t double, probs array<double>")
    init, trans = [0.4, 0.3, 0.2, 0.1], (np.eye(4) * 0.9 + 0.025).tolist()
    want = {(r.session, r.seq): r for r in decode.decode(rows, init, trans).collect()}
    got = {(r.session, r.seq): r for r in sliced.decode_slices(sliced.add_slices(rows, size=100, cuts=cuts), init, trans).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k].label_index == w.label_index and (w.posterior is None) == (got[k].posterior is None)
        assert w.posterior is None or np.allclose(got[k].posterior, w.posterior, atol=1e-9)
    with pytest.raises(ValueError):
        sliced.decode_slices(sliced.add_slices(rows), init, np.eye(4).tolist())


def test_one_session_with_all_rows_is_spread(spark):
    rows = spark.range(20_000).select(F.lit("all").alias("session"), F.col("id").alias("seq"), (F.col("id") / 50).alias("t"), F.array(F.lit(0.5), F.lit(0.5)).alias("probs"))
    sizes = [r["count"] for r in sliced.add_slices(rows, size=1000, cuts=31).groupBy("_slice").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 2 * 20_000 / 32


def test_the_registered_decode_is_that_of_one_stream(spark, sf):
    k = len(catalog.LABELS)
    trans = [[0.9 if i == j else 0.1 / (k - 1) for j in range(k)] for i in range(k)]
    rows = catalog.scored(spark, sf).select(F.lit("all").alias("session"), "t", "seq", F.array(*[f"p{i}" for i in range(k)]).alias("probs"))
    want = decode.decode(rows, [1 / k] * k, trans).select("seq", "label_index", F.round(F.array_max("posterior"), 6).alias("p"))
    assert values(catalog.QUERIES["hot_session_decode"](spark, sf), "seq", "label_index", "p") == values(want, "seq", "label_index", "p")
