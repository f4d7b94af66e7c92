"""Canonical views: the driver's tables read as motion data. One sensor row per event, one 64-point signal per embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types as activities.
ACTIVITIES = {"click": "walk", "view": "sit/lay", "purchase": "run", "signup": "stand", "error": "transitions"}
LABELS = ("walk", "run", "stairs", "sit/lay", "stand", "transitions", "locomotion-other")
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, t (seconds), x, y, z, activity."""
    events = table(spark, sf_dir, "events")
    activity = F.create_map(*[F.lit(v) for pair in ACTIVITIES.items() for v in pair])[F.col("event_type")]
    return events.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"),
        (F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, CAST(ts AS TIMESTAMP_NTZ))") / F.lit(1e6)).alias("t"),
        F.col("value").cast("double").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"),
        ((F.col("event_id") % 100) / F.lit(10.0)).alias("z"), activity.alias("activity"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v: array of doubles."""
    rows = table(spark, sf_dir, "embeddings")
    names = rows.columns
    vector = next(f.name for f in rows.schema.fields if f.dataType.typeName() == "array")
    key = next(n for n in names if n != vector)
    return rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor rows with a probability per label (p0..p6, sum 1) and the metrics that guards read."""
    rows = sensor(spark, sf_dir)
    raw = [(F.col("seq") * (37 * k + 11) + 7 * k * k) % 101 + 1 for k in range(len(LABELS))]
    total = sum(raw[1:], raw[0])
    return rows.select(
        "session", "seq", "t", "activity", *[(r / total).cast("double").alias(f"p{k}") for k, r in enumerate(raw)],
        (F.col("x") / 10.0).alias("energy"), (F.col("y") / 50.0).alias("jerk"), (F.col("seq") % 40 / 10.0).alias("dom"),
        (F.col("seq") % 37 / 10.0).alias("artifact"), (F.col("seq") % 3 == 0).alias("pocket"),
    )


SENSOR_SQL = """sensor AS (
  SELECT user_id AS session, event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS t, CAST(value AS DOUBLE) AS x,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, (event_id % 100) / 10.0::DOUBLE AS z,
         CASE event_type WHEN 'click' THEN 'walk' WHEN 'view' THEN 'sit/lay' WHEN 'purchase' THEN 'run' WHEN 'signup' THEN 'stand' WHEN 'error' THEN 'transitions' END AS activity
  FROM events)"""
SCORED_SQL = SENSOR_SQL + ", raw AS (SELECT *, " + ", ".join(f"CAST((seq * {37 * k + 11} + {7 * k * k}) % 101 + 1 AS DOUBLE) AS r{k}" for k in range(7)) + """ FROM sensor),
scored AS (SELECT session, seq, t, activity, """ + ", ".join(f"r{k} / (r0 + r1 + r2 + r3 + r4 + r5 + r6) AS p{k}" for k in range(7)) + """,
  x / 10.0 AS energy, y / 50.0 AS jerk, (seq % 40) / 10.0::DOUBLE AS dom, (seq % 37) / 10.0::DOUBLE AS artifact, seq % 3 = 0 AS pocket FROM raw)"""
