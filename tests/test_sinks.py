"""Batches as one commit each, replays, compaction; final summaries."""

import pytest
from pyspark.sql import functions as F

from strideflow.plans import catalog
from strideflow.sources.shared import new_path
from strideflow.streaming import sinks

RULES = {"points": sinks.Rule(keep=3), "latest": sinks.Rule(key="session", version="seq"), "log": sinks.Rule()}
POINT = "session long, seq long, t double, x double, gone boolean"


def changes(rows):
    newest = rows.groupBy("session").agg(F.max_by(F.struct("seq", "x", "gone"), "seq").alias("r")).select("session", "r.seq", "r.x", F.col("r.gone").alias("deleted"))
    return {"points": rows.drop("gone"), "latest": newest, "log": rows.select("session", "seq", "t")}


def held(store):
    return {n: sorted(map(tuple, store.table(n).collect())) if store.table(n) is not None else None for n in RULES}


def batches(spark, n=4):
    return [spark.createDataFrame([(s, 10 * k + j, float(10 * k + j), k + j / 10, s == 2 and k == n - 1) for s in (1, 2, 3) if s != 3 or k == 0 for j in range(2)], POINT) for k in range(n)]


def test_a_replayed_batch_changes_nothing(spark):
    store = sinks.Store(spark, new_path(spark, "store"), "q", RULES)
    assert store.table("latest") is None and store.compact() == -1
    for k, rows in enumerate(batches(spark)):
        assert store.commit(k, changes(rows))
    want = held(store)
    assert want["latest"] == [(1, 31, 3.1), (3, 1, 0.1)]  # 2 is deleted
    assert [r[:2] for r in want["points"]] == [(1, 21), (1, 30), (1, 31), (2, 21), (2, 30), (2, 31), (3, 0), (3, 1)] and len(want["log"]) == 18
    assert not store.commit(2, changes(batches(spark)[0])) and held(store) == want
    assert store.compact() == 3 == store.compact() and held(store) == want
    assert not store.commit(3, changes(batches(spark)[1])) and held(store) == want
    more = spark.createDataFrame([(2, 40, 40.0, 4.0, False)], POINT)
    assert store.commit(4, changes(more)) and (2, 40, 4.0) in held(store)["latest"]
    with pytest.raises(ValueError):
        store.commit(5, {"other": more})
    assert sinks.Store(spark, store.folder, "another", RULES).table("latest") is None


def test_a_batch_that_fails_between_tables_is_not_seen(spark):
    store = sinks.Store(spark, new_path(spark, "store"), "q", RULES)
    rows = batches(spark)
    store.commit(0, changes(rows[0]))
    want = held(store)
    broken = changes(rows[1]) | {"points": rows[1].drop("gone").withColumn("x", F.raise_error(F.lit("lost")).cast("double"))}
    with pytest.raises(Exception, match="lost"):
        store.commit(1, broken)  # latest and log are written by then
    assert held(store) == want
    store.commit(1, changes(rows[1]))
    whole = sinks.Store(spark, new_path(spark, "store"), "q", RULES)
    for k in range(2):
        whole.commit(k, changes(rows[k]))
    assert held(store) == held(whole)


def test_a_stream_that_fails_goes_on_where_it_was(spark, tmp_path):
    source = str(tmp_path / "in")
    for k, rows in enumerate(batches(spark)):
        rows.coalesce(1).write.mode("append").parquet(source)
    store, tries = sinks.Store(spark, new_path(spark, "store"), "q", RULES), []

    def once_broken(rows):
        tries.append(1)
        return changes(rows) | ({"log": rows.select("session", "seq", F.raise_error(F.lit("lost")).cast("double").alias("t"))} if len(tries) == 2 else {})

    def run():
        stream = spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(store.writer(once_broken)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception):  # noqa: B017
        run()
    run()
    whole = sinks.Store(spark, new_path(spark, "store"), "q", RULES)
    whole.commit(0, changes(spark.read.schema(POINT).parquet(source)))
    assert held(store) == held(whole)


HISTORY = "session long, seq long, t double, activity string, confidence double, quality double, cadence double, status string"


def test_summaries_of_ended_sessions(spark):
    history = [(1, k, k * 1.0, "walk" if k < 8 else "stand", 0.8, 90.0, 1.5 if k < 8 else 0.0, "success") for k in range(16)]
    history += [(2, 0, 0.0, "unknown", 0.1, 10.0, 0.0, "success"), (2, 1, 1.0, "walk", 0.1, 10.0, 0.0, "failed")]
    latest = [(2, 9, 9.0, "run", 0.9, 80.0, 2.0, "success"), (3, 9, 9.0, "run", 0.9, 80.0, 2.5, "success"), (4, 9, 9.0, "run", 0.9, 80.0, 2.0, "insufficient-samples"), (9, 9, 9.0, "run", 0.9, 80.0, 2.0, "success")]
    ended = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (6,), (1,), (None,)], "session long")
    done = spark.createDataFrame([(6,)], "session long")
    got = {r.session: r for r in sinks.finalise(ended, spark.createDataFrame(history, HISTORY), spark.createDataFrame(latest, HISTORY), done).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    one = got[1]
    assert (one.total_seconds, one.walking_seconds, one.stationary_seconds, one.estimated_steps, one.average_cadence_spm) == (16.0, 8.0, 8.0, 12, 90.0)
    assert one.time_by_activity == {"walk": 8.0, "stand": 8.0} and [(b.activity, b.duration_seconds, b.confidence_mean, b.cadence_spm) for b in one.activity_bouts] == [("walk", 8.0, 0.8, 90.0), ("stand", 8.0, 0.8, 0.0)]
    assert one.dominant_activity == "walk" and one.summary_text.startswith("Mostly walk over 16s.")
    assert (got[3].dominant_activity, got[3].total_seconds, got[3].peak_cadence_spm) == ("run", 0.7, 150.0)  # from its latest snapshot
    for s in (2, 4, 5):  # only invalid history, a snapshot that failed, nothing at all
        assert (got[s].dominant_activity, got[s].total_seconds, got[s].activity_bouts, got[s].time_by_activity) == ("unknown", 0.0, [], {})
        assert got[s].notes == [sinks.NO_WINDOWS] and got[s].summary_text == sinks.NO_DATA


def test_registered_query(spark, sf):
    got = catalog.QUERIES["finalised_sessions"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert not got.where("total_seconds > 0").isEmpty() and not got.where("total_seconds = 0").isEmpty()
