"""Helpers that the operators share: tables, the shared folder, vectorised word and shingle hashes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is used on one machine (``local``); on a cluster that is an error, as executors
    would write where nobody else can read.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strideflow-")
    if current.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage is cut, and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def _setting(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def planned_once(spark: SparkSession):
    """Inside, no plan is changed while it runs: an execution is one job.

    Each stage that adaptive execution adds plans again and takes a thread of the driver for a minute. What runs here has few rows.
    """
    return _setting(spark, {"spark.sql.adaptive.enabled": "false"})


def settled(df: DataFrame) -> DataFrame:
    """``checkpointed``, and the shuffle files behind it are removed at once, not when the driver happens to collect its garbage.

    Nothing reads them again: the checkpoint cuts the lineage. The setting holds for this one execution only.
    """
    with _setting(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        return checkpointed(df.select("*"))


def tidied(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage now, between steps of a long iteration.

    Spark removes old broadcasts and checkpoints only when that happens, and each stage leaves some MB of buffers behind
    for which the driver's heap would grow meanwhile.
    """
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.encode(column, "UTF-8"), F.lit(b""))


def word_count(column: str | Column) -> Column:
    """Number of words ``WORD``; null counts as none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


# --- vectorised text work inside Arrow batches ---------------------------------------------

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _power(n: int, forward: bool) -> np.ndarray:
    have = _powers[forward]
    if len(have) <= n:
        grown = np.full(max(n + 1, 2 * len(have)), _BASE if forward else _INVERSE, np.uint64)
        grown[0] = 1
        have = _powers[forward] = np.cumprod(grown)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece stay near ``most_bytes``; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64))
        start, base = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, ends[stop - 1]


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, end to end, and each row's bounds; null counts as empty."""
    array = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if array.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each row's bounds in them. No word crosses a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over the ring of 64-bit integers, then mixed."""
    forward, back = _power(len(data) + 1, True), _power(len(data) + 1, False)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of n consecutive word hashes; as many as there are full runs."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, (seed * 0x2545F4914F6CDD1D + n) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count]
    return mix(total)


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; with fewer words, the whole sequence as one."""
    if not len(words):
        return words
    return np.unique(sequence_hashes(words, min(n, len(words))))


# --- files in the shared folder --------------------------------------------------------------


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def open_new(folder: str, suffix: str):
    """A new file under a name that no other task or attempt uses: its URI and an open stream."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = _file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def open_old(uri: str):
    system, path = _file_system(uri)
    return system.open_input_file(path)
