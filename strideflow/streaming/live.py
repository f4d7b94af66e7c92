"""Live scoring with Structured Streaming: parse, scope, deduplicate, and score a rolling window per message in keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.functions.guards import ARTIFACT
from strideflow.operators.ordered import in_order
from strideflow.streaming.fold import KEEP, Guards, Memory, artifact, metrics, unit

MOST_SAMPLES, RING, WINDOW_SECONDS, POINTS, MIN_SHARE = 512, 6000, 2.56, 128, 0.8
NUMBER, MOST_MS = "BIGINT|DOUBLE|DECIMAL", 9.0e12  # beyond it a time in ns leaves 64 bits
POINTS_TYPE = "array<struct<timestampMs: double, acc: struct<x: double, y: double, z: double>, gyro: struct<alpha: double, beta: double, gamma: double>>>"
_N = r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"
PLAIN = f"^ARRAY<(VOID|OBJECT<acc: OBJECT<x: {_N}, y: {_N}, z: {_N}>, (gyro: OBJECT<alpha: {_N}, beta: {_N}, gamma: {_N}>, )?timestampMs: {_N}>)>$"
AT_ONCE = 512  # windows whose features are computed together
SNAPSHOT = "session STRING, message_id BIGINT, status STRING, n INT, window_end_ns BIGINT, energy DOUBLE, dom_freq_hz DOUBLE, cadence_spm DOUBLE, artifact DOUBLE, source STRING, label STRING, posterior ARRAY<DOUBLE>"
STATE = "ns ARRAY<BIGINT>, x ARRAY<DOUBLE>, y ARRAY<DOUBLE>, z ARRAY<DOUBLE>, posterior ARRAY<DOUBLE>, last_id BIGINT, window_end BIGINT, history ARRAY<DOUBLE>"
FIELDS = [tuple(f.split()) for f in SNAPSHOT.split(", ")]
COLUMNS = [n for n, _ in FIELDS]
ARROW = {"STRING": pa.string(), "BIGINT": pa.int64(), "INT": pa.int32(), "DOUBLE": pa.float64(), "ARRAY<DOUBLE>": pa.list_(pa.float64())}


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _is(value: Column, kinds: str) -> Column:
    """Whether a JSON value is of one of the kinds; false where it is missing."""
    return F.coalesce(F.schema_of_variant(value).rlike(f"^({kinds})"), F.lit(False))


def _given(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) != "VOID", F.lit(False))


def _missing(s: Column) -> Column:
    """Whether a typed sample lacks a value, or its time is no whole number in range."""
    ms, acc, gyro = s["timestampMs"], s["acc"], s["gyro"]
    lacks = ms.isNull() | (ms != F.floor(ms)) | (F.abs(ms) >= MOST_MS) | acc["x"].isNull() | acc["y"].isNull() | acc["z"].isNull()
    return lacks | (gyro.isNotNull() & (gyro["alpha"].isNull() | gyro["beta"].isNull() | gyro["gamma"].isNull()))


def _sample_error(sample: Column, index: Column) -> Column:
    """What is wrong with one sample, or null. A gyro may be left out, but not in part."""
    time, gyro = _at(sample, "timestampMs"), _at(sample, "gyro")
    ms = _at(sample, "timestampMs", "double")
    name = lambda field, rest: F.concat(F.lit("samples["), index.cast("string"), F.lit(f"]{field} must be {rest}."))
    number = lambda path: F.when(~_is(_at(sample, path), NUMBER), name(f".{path}", "numeric"))
    whole = _is(time, NUMBER) & F.coalesce((ms == F.floor(ms)) & (F.abs(ms) < MOST_MS), F.lit(False))
    return F.coalesce(
        F.when(~_is(sample, "OBJECT"), name("", "an object")), F.when(~whole, name(".timestampMs", "an integer")), F.when(~_is(_at(sample, "acc"), "OBJECT"), name(".acc", "an object")),
        F.when(_given(gyro) & ~_is(gyro, "OBJECT"), name(".gyro", "an object")), *[F.when(_given(gyro), number(f"gyro.{k}")) for k in ("alpha", "beta", "gamma")], *[number(f"acc.{k}") for k in "xyz"],
    )


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON batches to columns with ``error_reason``, null where the batch is valid, and ``error_text``, which names the field.

    Types are checked as JSON has them: truth values are no numbers, numbers no strings, a messageId has no fraction.
    """
    b, kind, typed, several = F.col("_b"), F.col("_k"), F.col("_t"), F.coalesce(F.col("_k").startswith("ARRAY"), F.lit(False))
    rows = raw.withColumn("_b", F.try_parse_json(F.col(column).cast("string")))
    rows = rows.withColumns({"_k": F.schema_of_variant(_at(b, "samples")), "_t": _at(b, "samples", POINTS_TYPE)})
    rows = rows.withColumn("_n", F.when(several, F.coalesce(F.array_size(typed), F.array_size(_at(b, "samples", "array<variant>")))))
    # one look at the merged type of all samples clears most batches; only the others are read value by value
    plain = F.coalesce(kind.rlike(PLAIN) & ~F.exists(typed, _missing), F.lit(False))
    errors = F.filter(F.transform(_at(b, "samples", "array<variant>"), _sample_error), lambda e: e.isNotNull())
    rows = rows.withColumn("_wrong", F.when(several & (F.col("_n") <= MOST_SAMPLES) & ~plain, F.get(errors, F.lit(0))))
    bad_text = lambda f: ~_is(_at(b, f), "STRING") | (F.coalesce(_at(b, f, "string"), F.lit("")) == "")
    checks = [  # the type of a whole body is asked for only where there is no id
        (~_is(_at(b, "messageId"), "BIGINT") & ~_is(b, "OBJECT"), "body", F.lit("body must be an object.")), (~_is(_at(b, "messageId"), "BIGINT"), "messageId", F.lit("messageId must be an integer.")),
        *[(bad_text(f), f, F.lit(f"{f} must be a non-empty string.")) for f in ("sessionId", "deviceId")],
        *[(_given(_at(b, f)) & bad_text(f), f, F.lit(f"{f} must be a non-empty string.")) for f in ("placementLabel", "source")],
        (~several, "samples", F.lit("samples must be an array.")), (F.col("_n") > MOST_SAMPLES, "too-many-samples", F.lit(f"samples exceeds max allowed per batch ({MOST_SAMPLES}).")),
        (F.col("_wrong").isNotNull(), "sample", F.col("_wrong")),
    ]
    fields = [_at(b, "messageId", "bigint").alias("messageId"), *[_at(b, f, "string").alias(f) for f in ("sessionId", "deviceId", "placementLabel", "source")], typed.alias("samples")]
    found = F.coalesce(*[F.when(c, F.struct(F.lit(n).alias("n"), t.alias("t"))) for c, n, t in checks])
    return rows.select(*raw.columns, *fields, found.alias("_e")).select("*", F.col("_e.n").alias("error_reason"), F.col("_e.t").alias("error_text")).drop("_e")


def scope(batches: DataFrame, sessions: DataFrame) -> DataFrame:
    """Reject batches whose token, expiry, session or device is wrong, in that order. Needs write_token, received_ns."""
    known = sessions.select("write_token", F.col("session_id").alias("_s"), F.col("device_id").alias("_d"), F.col("expires_ns").alias("_e"))
    both = batches.join(known, "write_token", "left")
    reason = F.when(F.col("_s").isNull(), "invalid-token").when(F.col("_e") <= F.col("received_ns"), "expired").when(F.col("_s") != F.col("sessionId"), "session-mismatch").when(F.col("_d") != F.col("deviceId"), "device-mismatch")
    return both.withColumn("error_reason", F.coalesce("error_reason", reason)).drop("_s", "_d", "_e")


def points(batches: DataFrame) -> DataFrame:
    """One row per sample: session, message_id, seq, ns, x, y, z."""
    rows = batches.where("error_reason is null").select(F.col("sessionId").alias("session"), F.col("messageId").alias("message_id"), F.posexplode("samples").alias("seq", "s"))
    return rows.select("session", "message_id", "seq", (F.col("s.timestampMs").cast("bigint") * 1_000_000).alias("ns"), "s.acc.x", "s.acc.y", "s.acc.z")


def deduplicate(batches: DataFrame, ttl: str = "6 hours") -> DataFrame:
    """The first arrival of each message; a stream needs the watermark column received_at."""
    keys = ["sessionId", "deviceId", "messageId"]
    if batches.isStreaming:
        return batches.withWatermark("received_at", ttl).dropDuplicatesWithinWatermark(keys)
    return batches.dropDuplicates(keys)


def latest_window(ns: np.ndarray, xyz: np.ndarray) -> tuple[str, np.ndarray | None, int]:
    """The last 2.56 s resampled to 128 points, or why it is not ready. First arrival wins a tie."""
    if not len(ns):
        return "no-data", None, 0
    ok = np.isfinite(xyz).all(1)
    if not ok.any():
        return "invalid-points", None, 0
    t = (ns - ns[ok].max()) / 1e9
    inside = np.flatnonzero(ok & (t >= -WINDOW_SECONDS))  # few of a full ring, so only these are sorted
    inside = inside[np.argsort(t[inside], kind="stable")]
    inside = inside[np.concatenate([[True], np.diff(ns[inside]) > 0])]
    t, xyz = t[inside], xyz[inside]
    if len(t) < 2:
        return "insufficient-samples", None, len(t)
    if t[-1] - t[0] < MIN_SHARE * WINDOW_SECONDS:
        return "insufficient-time-span", None, len(t)
    grid = -WINDOW_SECONDS + np.arange(POINTS) * WINDOW_SECONDS / POINTS
    return "success", np.stack([np.interp(grid, t, xyz[:, k]) for k in range(3)], axis=1), len(t)


@dataclass
class Session:
    """A session's state: the points that arrived last, the guards' memory, and where the last window ended."""

    ns: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    xyz: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    memory: Memory = field(default_factory=Memory)
    last_id: int = -1
    window_end: int | None = None


class Scorer:
    """Ring buffer, window, features, emission, guards and causal decoding, one snapshot a message.

    ``emit`` maps features (arrays with one entry a window) to one row of probabilities a window, or one for all. Features of all
    messages at hand are computed at once; only guards and decoding go message by message. Under low energy, decoding starts
    anew where it was sure of locomotion, and the session's metric history with it. Decoding also does where the window begins
    more than ``boundary_gap`` seconds after the one before ended (0: never). A ``decoder`` other than causal-hmm passes emissions on.
    """

    def __init__(self, labels: tuple[str, ...], emit, trans: np.ndarray | None = None, boundary_gap: float = 0.0, init: np.ndarray | None = None, decoder: str = "causal-hmm", pocket: bool = True):
        self.labels, self.emit, self.boundary_gap, self.decoder = labels, emit, boundary_gap, decoder
        k = len(labels)
        self.trans = np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)) if trans is None else trans
        self.init = np.full(k, 1 / k) if init is None else np.asarray(init, float)
        self.guards = Guards(labels, pocket)

    def messages(self, state: Session, session: str, batch: list[tuple[int, np.ndarray, np.ndarray]]) -> list[dict]:
        """Snapshots of messages (id, times, points) in their order; ``state`` moves on behind the last one."""
        if not batch:
            return []
        ns, xyz = (np.concatenate([held, *[m[k] for m in batch]]) for k, held in ((1, state.ns), (2, state.xyz)))
        ends = len(state.ns) + np.cumsum([len(m[1]) for m in batch])
        out = []
        for at in range(0, len(batch), AT_ONCE):
            rows, windows = [], []
            for (message_id, *_), end in zip(batch[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True):
                seen = slice(max(0, end - RING), end)
                status, window, n = latest_window(ns[seen], xyz[seen])
                rows.append(dict.fromkeys(COLUMNS) | {"session": session, "message_id": message_id, "status": status, "n": n, "window_end_ns": int(ns[seen].max()) if end else None})
                if window is not None:
                    windows.append(window)
            if windows:
                self._decode(state, [r for r in rows if r["status"] == "success"], np.stack(windows))
            out += rows
        state.ns, state.xyz, state.last_id = ns[-RING:], xyz[-RING:], batch[-1][0]
        return out

    def _decode(self, state: Session, rows: list[dict], windows: np.ndarray) -> None:
        from strideflow.functions.features import compute

        features = compute(windows)
        emissions = np.broadcast_to(np.asarray(self.emit(features), float), (len(rows), len(self.labels)))
        m, memory = metrics(features), state.memory
        for k, row in enumerate(rows):
            energy, dom, cadence, rhythm = (float(m[n][k]) for n in ("energy", "dom", "cadence", "periodicity"))
            emission, still = self.guards.before(emissions[k], energy, float(m["jerk"][k]), dom, memory.posterior)
            fresh = "initialized"
            if still and (memory.posterior is None or self.guards.sure_of_motion(memory.posterior)):
                memory.posterior, memory.history, fresh = None, memory.history[:0], "reset-low-motion"
            end = row["window_end_ns"]
            if self.boundary_gap > 0 and state.window_end is not None and end - int(WINDOW_SECONDS * 1e9) - state.window_end > self.boundary_gap * 1e9:
                memory.posterior = None
            state.window_end, last = end, memory.posterior
            posterior = unit(emission)
            if self.decoder == "causal-hmm":
                prior, source = (self.init, fresh) if last is None else (last @ self.trans, "continued")
                joint = prior * posterior
                posterior = joint / joint.sum() if joint.sum() > 0 else np.full(len(joint), 1 / len(joint))
            else:
                source = "disabled" if self.decoder == "none" else "unsupported-decoder"
            score = artifact(m["artifact"][k], memory.history)
            memory.history = np.concatenate([memory.history, m["artifact"][k : k + 1]])[-KEEP:]
            memory.posterior, corrected = self.guards.after(posterior, emission, energy, cadence, rhythm, score, last)
            row |= {"energy": energy, "dom_freq_hz": dom, "cadence_spm": cadence, "artifact": score, "source": "+".join([source, *corrected])}
            row |= {"label": self.labels[int(memory.posterior.argmax())], "posterior": memory.posterior.tolist()}


def energy_emission(f: dict) -> np.ndarray:
    """A simple emission over walk, run, stand from energy and frequency, for use before a model is fitted."""
    e = f["body_mag_energy"]
    still = np.exp(-e / 0.2)
    run = (1 - still) / (1 + np.exp(-(e - 8)))
    return np.stack([1 - still - run, run, still], axis=-1) + 1e-6


def score_stream(rows: DataFrame, scorer: Scorer, ttl_seconds: int | None = 6 * 3600) -> DataFrame:
    """Snapshots, one per message, of point rows (stream or not), in order of message id within what a trigger brings.

    Without a stream, a session is read in order and only its state is carried. In a stream, the state of a session
    that brings nothing for ``ttl_seconds`` is dropped; such a stream always runs another batch to look for it, so a run that is
    to end by itself (trigger availableNow) takes None, which keeps all state. Points without a message or a time are left out.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def score(state: Session, session: str, columns: list[np.ndarray]) -> list[dict]:
        ids, ns, x, y, z = columns
        xyz = np.stack([x, y, z], axis=1).astype(float)
        cuts = np.flatnonzero(np.diff(ids)) + 1
        starts = [0, *cuts] if len(ids) else []
        return scorer.messages(state, session, [(int(ids[a]), ns[a:b].astype(np.int64), xyz[a:b]) for a, b in zip(starts, [*cuts, len(ids)], strict=False)])

    if not rows.isStreaming:
        types = pa.schema([(n, ARROW[t]) for n, t in FIELDS])

        def ordered(session: str, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, left = Session(), None
            for piece in pieces:
                values = [piece.column(c).to_numpy(zero_copy_only=False) for c in ("message_id", "ns", "x", "y", "z")]
                values = values if left is None else [np.concatenate(pair) for pair in zip(left, values, strict=True)]
                whole = int((values[0] != values[0][-1]).sum())  # the last message may go on in the next piece
                left = [v[whole:] for v in values]
                yield pa.RecordBatch.from_pylist(score(state, session, [v[:whole] for v in values]), types)
            yield pa.RecordBatch.from_pylist(score(state, session, left), types)

        named = rows.where("message_id is not null and ns is not null").select(F.col("session").cast("string").alias("session"), F.col("message_id").cast("bigint").alias("message_id"), "seq", "ns", "x", "y", "z")
        return in_order(named, ("message_id", "seq"), ordered, SNAPSHOT)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = Session()
        if held.exists:
            ns, x, y, z, posterior, last, end, history = held.get
            memory = Memory(np.array(posterior) if posterior else None, np.array(history, float).reshape(-1, len(ARTIFACT)))
            state = Session(np.array(ns, np.int64), np.array([x, y, z], float).T.reshape(-1, 3), memory, last, end)
        whole = pd.concat(list(frames)).sort_values(["message_id", "seq"])
        out = score(state, key[0], [whole[c].to_numpy() for c in ("message_id", "ns", "x", "y", "z")])
        posterior = [] if state.memory.posterior is None else state.memory.posterior.tolist()
        held.update((state.ns.tolist(), *[state.xyz[:, k].tolist() for k in range(3)], posterior, state.last_id, state.window_end, state.memory.history.ravel().tolist()))
        if ttl_seconds is not None:
            held.setTimeoutDuration(max(1, ttl_seconds) * 1000)
        yield pd.DataFrame(out, columns=COLUMNS)

    timeout = GroupStateTimeout.NoTimeout if ttl_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.where("message_id is not null and ns is not null").groupBy("session").applyInPandasWithState(run, SNAPSHOT, STATE, "append", timeout)


def serialised(snapshots: DataFrame) -> DataFrame:
    """Snapshots as JSON, fields without a value included."""
    return snapshots.select("session", "message_id", F.to_json(F.struct(*snapshots.columns), {"ignoreNullFields": "false"}).alias("json"))


def lifetime(seconds: Column, most: int) -> Column:
    """A requested lifetime held between a second and ``most``."""
    return F.least(F.greatest(F.lit(1), seconds), F.lit(most))


def viewers(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """``error_reason`` of requests to read a session: needs view_token, session_id, asked_ns; sessions have view_token, session_id, expires_ns."""
    known = sessions.select("view_token", F.col("session_id").alias("_s"), F.col("expires_ns").alias("_e"))
    reason = F.when(F.col("_s").isNull(), "invalid-token").when(F.col("_s") != F.col("session_id"), "session-mismatch").when(F.col("_e") <= F.col("asked_ns"), "expired")
    return requests.join(known, "view_token", "left").withColumn("error_reason", reason).drop("_s", "_e")


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each session."""
    fields = [c for c in snapshots.columns if c != "session"]
    return snapshots.groupBy("session").agg(F.max_by(F.struct(*fields), "message_id").alias("s")).select("session", "s.*")
