"""The stateful operators as Structured Streaming jobs.

State lives per camera and domain (or per track for plates) in the RocksDB store.  Rows
wait in the state until the watermark has passed their time and are then handled frame by
frame, in order, by the same step the batch form uses.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sightline.policy import PlatePolicy
from sightline.streaming.batch import INPUTS, make_session, seen_row

EVENTS = T.StructType(
    [
        T.StructField("camera_id", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("target_id", T.LongType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("identity_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("support", T.DoubleType()),
    ]
)
_BLOB = T.StructType([T.StructField("blob", T.BinaryType())])


class SessionProcessor(StatefulProcessor):
    """One camera and domain: waiting frames and the session they will be handed to."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _BLOB)

    def _load(self, key: tuple) -> dict:
        if self.state.exists():
            return pickle.loads(self.state.get()[0])
        return {"session": make_session(key[1], self.options), "waiting": {}, "done": None}

    def _release(self, key: tuple, held: dict, timers: Any) -> pd.DataFrame:
        """Handle every frame the watermark has passed; ask to be woken for the next one."""
        watermark = timers.getCurrentWatermarkInMs()
        out = []
        for frame in sorted(held["waiting"]):
            ts, n, rows = held["waiting"][frame]
            if ts * 1000.0 > watermark:
                self.handle.registerTimer(int(ts * 1000.0) + 1)
                break
            del held["waiting"][frame]
            held["done"] = frame
            seen = sorted((r for v in rows if (r := seen_row(v)) is not None), key=lambda r: r.track)
            out += [(*key, frame, *e) for e in held["session"].frame(frame, ts, n, seen)]
        self.state.update((pickle.dumps(held),))
        return pd.DataFrame(out, columns=EVENTS.names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, late = self._load(tuple(key)), []
        for pdf in rows:
            heads = zip(pdf["frame_index"].tolist(), pdf["ts"].tolist(), pdf["n_identities"].tolist())
            for (frame, ts, n), values in zip(heads, zip(*[pdf[c].tolist() for c in INPUTS])):
                # A frame that was already handled cannot be taken back; its rows are reported.
                if held["done"] is None or frame > held["done"]:
                    held["waiting"].setdefault(frame, (ts, int(n), []))[2].append(values)
                else:
                    track = -1 if values[0] is None or values[0] != values[0] else int(values[0])
                    late.append((*key, int(frame), "late", -1, track, -1, None, None))
        if late:
            yield pd.DataFrame(late, columns=EVENTS.names)
        yield self._release(tuple(key), held, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._release(tuple(key), self._load(tuple(key)), timerValues)

    def close(self) -> None:
        pass


def session_stream(inputs: DataFrame, options: dict | None = None, delay: str = "2 seconds") -> DataFrame:
    """Identity events of a stream of session inputs (see ``lifecycle.session_inputs``).

    ``event_time`` carries the time of the frame; ``ts`` is the same in seconds.
    """
    return (
        inputs.withWatermark("event_time", delay)
        .groupBy("camera_id", "domain")
        .transformWithStateInPandas(
            statefulProcessor=SessionProcessor(options or {}),
            outputStructType=EVENTS,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


CONFIRMED = T.StructType(
    [
        T.StructField("camera_id", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("track_epoch", T.LongType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("plate", T.StringType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("sharpness", T.DoubleType()),
        T.StructField("late", T.BooleanType()),
    ]
)
_READING = "at long, epoch long, bound boolean, plate string, conf double, sharpness double"


class PlateProcessor(StatefulProcessor):
    """Votes of one track in typed state: waiting readings by frame and number, hits by plate, the last frame.

    Readings wait until the watermark has passed them and are then counted in order.  A reading
    that comes after its time goes to the output with ``late`` set and changes nothing.  Votes
    lapse like in the batch form; an idle track is forgotten by timer.
    """

    def __init__(self, policy: PlatePolicy, idle_seconds: float) -> None:
        self.policy, self.idle = policy, int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame long, number long", _READING)
        self.votes = handle.getMapState("votes", "plate string", "hits int")
        # The last frame that was counted, its epoch and time, and whether a plate is stable.
        self.last = handle.getValueState("last", "frame long, epoch long, at long, stable boolean")

    def _count(self, key: tuple, frame: int, reading: tuple) -> list:
        at, epoch, bound, plate, conf, sharpness = reading
        before, old, _, stable = self.last.get() if self.last.exists() else (None, None, None, False)
        if old is not None and epoch != old:
            self.votes.clear()
            stable = stable and bound
        elif before is not None and frame - before > self.policy.pending_max_age:
            self.votes.clear()
        out = []
        if not stable:
            hits = (self.votes.getValue((plate,))[0] if self.votes.containsKey((plate,)) else 0) + 1
            if hits >= self.policy.hits:
                stable = True
                self.votes.clear()
                out.append((*key, epoch, frame, plate, conf, sharpness, False))
            else:
                self.votes.updateValue((plate,), (hits,))
        self.last.update((frame, epoch, at, stable))
        return out

    def _release(self, key: tuple, timers: Any) -> list:
        """Count what the watermark has passed; ask to be woken for the next reading or the end."""
        watermark, out = timers.getCurrentWatermarkInMs(), []
        for frame, number in sorted(tuple(k) for k in self.waiting.keys()):
            reading = tuple(self.waiting.getValue((frame, number)))
            if reading[0] > watermark:
                self.handle.registerTimer(reading[0] + 1)
                return out
            self.waiting.removeKey((frame, number))
            out += self._count(key, frame, reading)
        if self.last.exists():
            self.handle.registerTimer(self.last.get()[2] + self.idle)
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        key, late, ended = tuple(key), [], False
        done = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            if "end" in pdf.columns:
                marks = pdf["end"].fillna(False).astype(bool)
                ended = ended or bool(marks.any())
                pdf = pdf[~marks]
            columns = ["frame_index", "ts", "track_epoch", "bound", "plate", "conf", "sharpness"]
            for frame, ts, epoch, bound, plate, conf, sharpness in zip(*[pdf[c].tolist() for c in columns]):
                if done is not None and frame <= done:
                    late.append((*key, int(epoch), int(frame), plate, float(conf), float(sharpness), True))
                else:
                    reading = (int(ts * 1000), int(epoch), bool(bound), plate, float(conf), float(sharpness))
                    number = 0
                    while self.waiting.containsKey((int(frame), number)):
                        number += 1
                    self.waiting.updateValue((int(frame), number), reading)
        out = self._finish(key) if ended else self._release(key, timerValues)
        yield pd.DataFrame(late + out, columns=CONFIRMED.names)

    def _finish(self, key: tuple) -> list:
        """The recording is over: count all that waits, and forget the track."""
        out = []
        for frame, number in sorted(tuple(k) for k in self.waiting.keys()):
            out += self._count(key, frame, tuple(self.waiting.getValue((frame, number))))
            self.waiting.removeKey((frame, number))
        self.votes.clear()
        self.last.clear()
        return out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = self._release(tuple(key), timerValues)
        idle = self.last.exists() and self.last.get()[2] + self.idle <= timerValues.getCurrentWatermarkInMs()
        if idle and not any(True for _ in self.waiting.keys()):
            self.votes.clear()
            self.last.clear()
        yield pd.DataFrame(out, columns=CONFIRMED.names)

    def close(self) -> None:
        pass


def plate_stream(
    readings: DataFrame, policy: PlatePolicy, delay: str = "2 seconds", idle_seconds: float = 3600.0
) -> DataFrame:
    """Confirmed plates of a stream of gated readings, per camera, domain and track.

    ``event_time`` is the time of the frame, ``ts`` the same in seconds; ``track_epoch`` counts
    a track's uninterrupted appearances, ``bound`` tells whether it follows a target. A row with
    ``end`` set (``feeds.end_rows``) finishes its track: readings that still wait are counted.
    """
    return (
        readings.withWatermark("event_time", delay)
        .groupBy("camera_id", "domain", "track_id")
        .transformWithStateInPandas(
            statefulProcessor=PlateProcessor(policy, idle_seconds),
            outputStructType=CONFIRMED,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A growing folder of parquet files as a source; back-pressure by files per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def source_status(reads: DataFrame) -> DataFrame:
    """Status of each read: a frame, the end of a file, or a camera's temporary failure."""
    status = (
        F.when(F.col("ok"), "FRAME").when(F.col("is_camera"), "TEMPORARY_FAILURE").otherwise("EOF")
    )
    return reads.withColumn("status", status)


def write_batches(stream: DataFrame, path: str, checkpoint: str, prepare=None):
    """Append a stream to a table so that a repeated batch replaces itself.

    Every micro-batch owns one folder named after its number; after a failure the batch is
    run again and overwrites only that folder.
    """

    def save(df: DataFrame, batch_id: int) -> None:
        rows = prepare(df) if prepare is not None else df
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
