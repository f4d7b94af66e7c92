"""Readers of recording files and writers of the windowed contract: Spark readers, typed schemas, file paths parsed by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideflow.operators import timeseries

#: Contract columns and types.
CONTRACT = (
    "dataset_enum STRING, dataset_id STRING, stream_id STRING, split STRING, global_subject_id STRING, subject_local_id STRING, global_session_id STRING, source_session_id STRING, "
    "global_window_id STRING, window_index INT, sample_index SMALLINT, time_s FLOAT, activity_label STRING, activity_name_raw STRING, is_report_activity BOOLEAN, placement_label STRING, "
    "sample_rate_hz SMALLINT, acc_x FLOAT, acc_y FLOAT, acc_z FLOAT"
)
REPORTED = ("walk", "run", "stairs", "sit/lay", "stand")


def normal_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def semicolon_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``subject,activity,ns,x,y,z;``: blank, short and unparsable lines are left out."""
    part = F.split(F.rtrim(F.regexp_replace("value", r";\s*$", "")), ",")
    typed = [F.expr(f"try_cast(trim(p[{k}]) AS {t})").alias(n) for k, n, t in ((0, "subject", "STRING"), (1, "activity", "STRING"), (2, "ns", "BIGINT"), (3, "x", "DOUBLE"), (4, "y", "DOUBLE"), (5, "z", "DOUBLE"))]
    rows = spark.read.text(path).withColumn("p", part).where(F.size("p") == 6).select(*typed, F.col("_metadata.file_path").alias("path"))
    return rows.where("ns is not null and x is not null and y is not null and z is not null")


def header_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV by header names over a folder tree; blank and unnamed headers are left out, missing columns raise."""
    frame = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    named = frame.select(*[c for c in frame.columns if c.strip() and not c.startswith(("Unnamed:", "_c"))], F.col("_metadata.file_path").alias("path"))
    want = [x.strip().split(" ") for x in schema.split(",")]
    if missing := [n for n, _ in want if n not in named.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return named.select(*[F.expr(f"try_cast(`{n}` AS {t})").alias(n) for n, t in want], "path")


def headless_csv(spark: SparkSession, path: str, positions: dict[int, str], skip: int = 0) -> DataFrame:
    """CSV by position: numbers where they parse, the label (``activity``) as text; rows with a broken number are left out."""
    rows = spark.read.text(path, wholetext=False).select(F.split("value", ",").alias("p"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"))
    if skip:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("_n") > skip).drop("_n")
    cells = [(F.trim(F.get("p", F.lit(k))) if n == "activity" else F.expr(f"try_cast(trim(get(p, {k})) AS DOUBLE)")).alias(n) for k, n in positions.items()]
    return rows.select("path", "line", *cells).dropna(subset=list(positions.values()))


def recording_folder(path: Column, activities: tuple[str, ...]) -> tuple[Column, Column]:
    """Activity and placement of ``placement-activity-YYYY-MM-DD_HH-MM-SS`` folders; null where no activity fits."""
    stem = F.regexp_extract(path, r"([^/]+)-\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}(?:/|$)", 1)
    activity = F.coalesce(*[F.when(stem.endswith("-" + a), F.lit(a)) for a in activities])
    return activity, F.when(activity.isNotNull(), F.substring(stem, F.lit(1), F.length(stem) - F.length(activity) - 1))


def holdout(subjects: DataFrame, rule: str, values: tuple[int, ...] = (), column: str = "subject") -> DataFrame:
    """subject, split. Rules: none, exact, list (the ids as they stand, else one less each; raises where neither are all there), every-fifth."""
    n = F.col(column).cast("int")
    ids = subjects.select(column).distinct()
    zero = F.min(n).over(Window.partitionBy()) == 0
    if rule == "none":
        test = F.lit(False)
    elif rule == "exact":
        test = n.isin(*values)
    elif rule == "list":
        have = {row[0] for row in ids.where(n.isin(*values, *(v - 1 for v in values))).select(n).collect()}  # at most two for each value
        based = next((k for k in (0, 1) if {v - k for v in values} <= have), None)
        if based is None:
            raise ValueError(f"subjects {sorted(values)} are not all there, nor those one less")
        test = n.isin(*(v - based for v in values))
    elif rule == "every-fifth":
        test = F.when(zero, (n + 1) % 5 == 0).otherwise(n % 5 == 0)
    else:
        raise ValueError(f"no such rule: {rule}")
    return ids.select(column, F.when(test, "test").otherwise("train").alias("split"))


def map_labels(rows: DataFrame, names: dict[str, str | None], raw: str = "raw", label: str = "activity") -> DataFrame:
    """The rows whose raw activity name, normalised, has a label; others, and names mapped to none, are left out."""
    known = {k: v for k, v in names.items() if v is not None}
    found = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[normal_name(F.col(raw))] if known else F.lit(None).cast("string")
    return rows.withColumn(label, found).where(F.col(label).isNotNull())


def remap(label: Column, names: dict[str, str]) -> Column:
    """Labels merged or renamed; others stay."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[label], label) if names else label


def placement(name: Column, aliases: dict[str, str], models: dict[str, str]) -> Column:
    """The model's placement of a recording's: aliases first; names without a model placement stay."""
    return remap(remap(name, aliases), models)


def one_hot(name: Column, names: tuple[str, ...], unknown: str = "unknown_free_living") -> dict[str, Column]:
    """A 0/1 column for each placement; a placement that isn't among them counts as ``unknown``."""
    known = F.when(name.isin(*names), name).otherwise(unknown)
    return {f"placement_{n}": (known == n).cast("float") for n in names}


def scaled(rows: DataFrame, factor: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Axes in metres per square second."""
    return rows.withColumns({a: F.col(a) * factor for a in axes})


def position_file(path: Column, position: Column) -> tuple[Column, Column]:
    """Subject and raw activity of ``proband<subject>/.../acc_<activity>_<position>.csv``; null where the name is another."""
    stem = F.regexp_extract(path, r"([^/]+)\.csv$", 1)
    tail = F.concat(F.lit("_"), position)
    fits = stem.startswith("acc_") & stem.endswith(tail) & (F.length(stem) > 4 + F.length(tail))
    subject = F.regexp_extract(path, r"proband([^/]+)/", 1)
    return F.when(subject != "", subject), F.when(fits, F.substring(stem, F.lit(5), F.length(stem) - 4 - F.length(tail)))


def subject_file(path: Column, prefix: str, ending: str) -> Column:
    """Subject of ``<prefix>_<subject>...<ending>``, as in ``data_1600_accel_phone.txt`` or ``Participant_3.csv``; null where the name is another."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - len(ending))
    return F.when(name.startswith(f"{prefix}_") & name.endswith(ending), F.split(stem, "_")[1])


def trial_side(trial: Column, code: Column) -> Column:
    """The pocket of a trial: falls have three on each side, others the first on the right."""
    fall = code.startswith("Falling") | code.isin("HittingObstacle", "Syncope")
    return F.when(trial <= F.when(fall, 3).otherwise(1), "front_pocket_right").otherwise("front_pocket_left")


def segment_session(session: Column, segment: Column, segments: Column) -> Column:
    """The source session's id, with its segment where gaps made several."""
    return F.when(segments > 1, F.concat(session.cast("string"), F.lit(":segment:"), segment.cast("string"))).otherwise(session.cast("string"))


def flush_sessions(rows: DataFrame, names: dict[str, str | None], factor: float = 1.0, max_gap: float = 0.25, step: float = 0.02, size: int = 128, hop: int = 64) -> DataFrame:
    """From raw samples (session, seq, t, x, y, z, subject, split, raw, placement) to the windows of labelled sessions.

    Labels, scale, sanitized times, gap segments, a regular grid in each segment, count windows; session, subject, split, raw,
    activity and placement are the session's own. Everything is partitioned by session or segment; nothing holds a session.
    """
    own = ["subject", "split", "raw", "activity", "placement"]
    kept = timeseries.gap_segments(timeseries.sanitize(scaled(map_labels(rows, names), factor)), max_gap)
    last = F.max("segment").over(Window.partitionBy("session"))
    kept = kept.withColumn("_segment", segment_session(F.col("session"), F.col("segment"), last + 1))
    facts = kept.groupBy("_segment").agg(*[F.first(c).alias(c) for c in own])
    grid = timeseries.resample(kept.select("_segment", F.col("t_segment").alias("t"), "seq", "x", "y", "z"), step, key="_segment")
    windows = timeseries.sliding_windows(grid.withColumns({"t": F.col("i") * step, "seq": F.col("i")}), size, hop, key="_segment")
    return windows.join(facts, "_segment").withColumnRenamed("_segment", "session").select("session", *own, "window_index", "sample_index", "x", "y", "z")


def pick_files(paths: DataFrame, most: int) -> DataFrame:
    """Of part files by path, the first ``most`` in order of name of each split (``split=...`` in the path); all where ``most`` is not positive."""
    if most <= 0:
        return paths
    split = F.regexp_extract("path", r"split=([^/]+)", 1)
    ranked = paths.withColumn("_n", F.row_number().over(Window.partitionBy(split).orderBy("path")))
    return ranked.where((F.col("_n") <= most) & (split != "")).drop("_n")


def union_of_paths(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Each path of several lists once, in order of name."""
    out = first.select("path")
    for more in others:
        out = out.union(more.select("path"))
    return out.distinct().orderBy("path")


def contract(windows: DataFrame, dataset: str, stream: str, rate: int = 50) -> DataFrame:
    """The sample table from windowed rows: session, subject, split, activity (label), raw, placement, window_index, sample_index, x, y, z."""
    session = F.format_string(f"{dataset}:{stream}:session:%s", F.col("session").cast("string"))
    columns = {
        "dataset_enum": F.lit(dataset.upper()), "dataset_id": F.lit(dataset), "stream_id": F.lit(stream), "split": F.col("split"), "global_subject_id": F.format_string(f"{dataset}:subject:%s", F.col("subject").cast("string")),
        "subject_local_id": F.col("subject").cast("string"), "global_session_id": session, "source_session_id": F.col("session").cast("string"), "global_window_id": F.concat(session, F.lit(":window:"), F.col("window_index").cast("string")),
        "window_index": F.col("window_index"), "sample_index": F.col("sample_index"), "time_s": F.col("sample_index") / rate, "activity_label": F.col("activity"), "activity_name_raw": F.col("raw"),
        "is_report_activity": F.col("activity").isin(*REPORTED), "placement_label": F.col("placement"), "sample_rate_hz": F.lit(rate), "acc_x": F.col("x"), "acc_y": F.col("y"), "acc_z": F.col("z"),
    }
    types = dict(x.split(" ") for x in CONTRACT.split(", "))
    return windows.select(*[c.cast(types[n]).alias(n) for n, c in columns.items()])


def write_contract(samples: DataFrame, folder: str) -> None:
    """Samples by split, dataset and stream; window and session manifests; a summary."""
    samples.write.mode("overwrite").option("compression", "zstd").partitionBy("split", "dataset_id", "stream_id").parquet(f"{folder}/samples")
    keys = ["dataset_id", "stream_id", "split", "global_subject_id", "global_session_id", "activity_label"]
    windows = samples.groupBy(*keys, "global_window_id", "window_index", "sample_rate_hz").agg(F.count("*").alias("window_samples"))
    windows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/window_manifest")
    windows.groupBy(*keys).agg(F.count("*").alias("window_count")).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/session_manifest")
    windows.groupBy("dataset_id", "stream_id", "split", "activity_label").agg(F.count_distinct("global_session_id").alias("sessions"), F.count("*").alias("windows"), F.sum("window_samples").alias("samples")).orderBy("dataset_id", "stream_id", "split", "activity_label").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")


def read_windows(spark: SparkSession, folder: str, size: int = 128) -> DataFrame:
    """Whole windows as arrays x, y, z in sample order; partitions are pruned by later filters."""
    rows = spark.read.parquet(f"{folder}/samples")
    keys = ["split", "dataset_id", "stream_id", "global_window_id", "global_subject_id", "global_session_id", "activity_label", "placement_label"]
    grouped = rows.where(F.col("sample_index").between(0, size - 1)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample_index", "acc_x", "acc_y", "acc_z"))).alias("s")).where(F.size("s") == size)
    axis = lambda c: F.transform("s", lambda v: v[f"acc_{c}"].cast("double")).alias(c)
    return grouped.select(*keys, *map(axis, "xyz"))
