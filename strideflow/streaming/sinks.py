"""Tables that a stream changes by whole batches, and the final summaries of sessions that have ended.

A batch writes its changes to all tables under its own number, and last a commit. Readers take committed batches only, so
a batch that fails between two tables is never half seen, and one that is replayed writes the same folders anew or, once
committed, nothing. Changes are rows: appended ones, or the newest version of a key, with ``deleted`` where it goes. What
tables hold is worked out on reading, up to the last compaction by one pass over few rows; appended tables are trimmed then.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.operators import recap, timeseries
from strideflow.sources.shared import checkpointed


@dataclass(frozen=True)
class Rule:
    """How a table's rows add up: ``key`` with ``version``: the newest stands, a later batch of equals; else all, the last ``keep`` a session by (t, seq)."""

    key: str | None = None
    version: str = "version"
    keep: int = 0


class Store:
    """Tables in a folder that all executors see. ``query`` tells streams apart that write to one folder; each has its own commits."""

    def __init__(self, spark: SparkSession, folder: str, query: str, rules: dict[str, Rule]):
        self.spark, self.folder, self.query, self.rules = spark, folder.rstrip("/"), query, rules

    def _read(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(str(path.toString()))

    def _commits(self, kind: str) -> list[tuple[int, list[str]]]:
        """Numbers and tables of this query's commits: a row a batch since the last compaction."""
        found = self._read(f"{kind}/query={self.query}")
        return [] if found is None else sorted((r.number, list(r.tables)) for r in found.select("number", "tables").collect())

    def _commit(self, kind: str, number: int, tables: Sequence[str]) -> None:
        row = self.spark.createDataFrame([(number, sorted(tables))], "number long, tables array<string>").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.folder}/{kind}/query={self.query}/of={number}")

    def commit(self, number: int, changes: dict[str, DataFrame]) -> bool:
        """Write a batch's changes; False, and nothing else, if it was committed before."""
        if unknown := set(changes) - set(self.rules):
            raise ValueError(f"no such table: {sorted(unknown)}")
        base = self._commits("compactions")
        if any(n == number for n, _ in self._commits("commits")) or base and number <= base[-1][0]:
            return False
        for name, rows in sorted(changes.items()):
            rows.write.mode("overwrite").parquet(f"{self.folder}/tables/{name}/query={self.query}/batch={number}")
        self._commit("commits", number, list(changes))
        return True

    def writer(self, changes: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda rows, number: self.commit(number, changes(rows)) and None

    def table(self, name: str) -> DataFrame | None:
        """What the table holds after the committed batches; None before the first."""
        rule, base, parts = self.rules[name], self._commits("compactions"), []
        low = base[-1][0] if base else -1
        folder = f"{self.folder}/tables/{name}/query={self.query}"
        if base and name in base[-1][1]:
            parts.append(self.spark.read.parquet(f"{folder}/base={low}").withColumn("_batch", F.lit(-1).cast("long")))
        parts += [self.spark.read.parquet(f"{folder}/batch={n}").withColumn("_batch", F.lit(n).cast("long")) for n, names in self._commits("commits") if n > low and name in names]
        if not parts:
            return None
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        if not rule.key:
            rows = rows.drop("_batch")
            return timeseries.tail_rows(rows, rule.keep) if rule.keep else rows
        fields = [c for c in rows.columns if c not in (rule.key, "_batch")]
        newest = rows.groupBy(rule.key).agg(F.max_by(F.struct(*fields), F.struct(rule.version, "_batch")).alias("_r")).select(rule.key, "_r.*")
        return newest.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in fields else newest

    def compact(self) -> int:
        """Write what every table holds as a new base; its number is that of the last batch in it (-1: there was none).

        Keys that were deleted are gone then, so changes of theirs with an older version must not come later.
        """
        done = self._commits("commits")
        if not done:
            return -1
        low, names = done[-1][0], []
        if (base := self._commits("compactions")) and base[-1][0] == low:
            return low
        for name in self.rules:
            if (rows := self.table(name)) is not None:
                rows.write.mode("overwrite").parquet(f"{self.folder}/tables/{name}/query={self.query}/base={low}")
                names.append(name)
        self._commit("compactions", low, names)
        return low


# --- final summaries --------------------------------------------------------------------------------------------

HISTORY = ("session", "seq", "t", "activity", "confidence", "quality", "cadence")
NO_WINDOWS, NO_DATA = "No valid inference windows were available to summarize.", "No usable live activity data was captured."


def finalise(ended: DataFrame, history: DataFrame, latest: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """One summary for each session of ``ended`` that isn't ``done`` yet: rounded figures, times by activity, bouts, notes and text.

    It is made of the session's history; where there is none, of its latest snapshot if that succeeded; where nothing valid is
    left, the summary says so. ``history`` and ``latest`` have the columns of HISTORY and maybe ``status``.
    """
    wanted = ended.select("session").where("session is not null").distinct()
    if done is not None:
        wanted = wanted.join(done.select("session"), "session", "left_anti")
    status = lambda df: [F.col("status") if "status" in df.columns else F.lit("success").alias("status")]
    own = history.select(*HISTORY, *status(history)).join(wanted, "session", "left_semi")
    bare = wanted.join(own.select("session").distinct(), "session", "left_anti")
    last = latest.select(*HISTORY, *status(latest)).join(bare, "session", "left_semi").where("status = 'success'")
    entries = checkpointed(recap.history(own.unionByName(last)))
    bouts = checkpointed(recap.denoise(recap.bouts(entries)))
    told = recap.summary(entries, bouts)

    tenth = lambda c: F.bround(c, 1)
    mean = lambda c: F.col(c) / F.greatest(F.col("duration"), F.lit(1e-9))
    bout = F.struct("run", "activity", tenth("duration").alias("duration_seconds"), F.bround(mean("confidence_s"), 2).alias("confidence_mean"), tenth(mean("quality_s")).alias("signal_quality_mean"),
                    tenth(F.coalesce(60 * F.try_divide("cadence_s", "cadence_d"), F.lit(0.0))).alias("cadence_spm"))
    lists = bouts.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(bout)), lambda b: b.dropFields("run")).alias("activity_bouts"))
    times = recap.by_activity(bouts).where("seconds > 0").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("first_run", "activity", tenth("seconds").alias("seconds")))).alias("_t"))
    times = times.select("session", F.map_from_entries(F.transform("_t", lambda x: F.struct(x["activity"], x["seconds"]))).alias("time_by_activity"))

    out = wanted.join(told, "session", "left").join(lists, "session", "left").join(times, "session", "left")
    figures = ("total_seconds", "walking_seconds", "stationary_seconds", "locomotion_seconds", "longest_walk_bout_seconds", "estimated_distance_m", "average_cadence_spm", "peak_cadence_spm", "signal_quality_mean", "signal_quality_min")
    none = F.col("total_seconds").isNull()
    return out.select(
        "session", F.lit("finalized").alias("status"), F.coalesce("dominant_activity", F.lit("unknown")).alias("dominant_activity"), *[F.coalesce(tenth(n), F.lit(0.0)).alias(n) for n in figures],
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("estimated_steps", "posture_change_count", "noise_bouts_folded")],
        F.coalesce("time_by_activity", F.create_map().cast("map<string,double>")).alias("time_by_activity"), F.when(none, F.array().cast(out.schema["activity_bouts"].dataType)).otherwise(F.col("activity_bouts")).alias("activity_bouts"),
        F.when(none, F.array(F.lit(NO_WINDOWS))).otherwise(F.col("notes")).alias("notes"), F.when(none, NO_DATA).otherwise(F.col("summary_text")).alias("summary_text"),
    )
