"""Readers of recordings whose header may stand under another line, and times for recordings that have none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def named_csv(spark: SparkSession, path: str, columns: Sequence[str], key: str) -> DataFrame:
    """Numbers of the named columns from CSVs over a folder tree; ``path`` names the file.

    A file's header is its line with the cell ``key``, wherever that stands, so a title line above it or a repeated header
    does no harm; the columns may be in another order in each file. Rows with a missing or broken number are left out, and
    so are files without such a header.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    rows = lines.select(F.col("_metadata.file_path").alias("path"), cells.alias("cells"))
    heads = rows.where(F.array_contains("cells", key)).groupBy("path").agg(F.min("cells").alias("names"))
    placed = rows.join(heads, "path")
    number = lambda n: F.get("cells", (F.array_position("names", F.lit(n)) - 1).cast("int")).try_cast("double")
    return placed.select("path", *[number(n).alias(n) for n in columns]).dropna(subset=list(columns))


def synthetic_time(rows: DataFrame, rate: float = 50.0, key: Sequence[str] = ("session",), order_by: Sequence[str] = ("seq",)) -> DataFrame:
    """``t`` from a row's place in its series: 0, 1/rate, 2/rate, ..."""
    return rows.withColumn("t", (F.row_number().over(Window.partitionBy(*key).orderBy(*order_by)) - 1) / F.lit(float(rate)))
