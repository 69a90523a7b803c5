"""Streams that need no fold of their own: late results, shared embeddings, expiry, ends of recordings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sightline.operators.plates import TRACK, current_state, with_stale_reason
from sightline.policy import PlatePolicy


def stale_reason_stream(
    results: DataFrame,
    states: DataFrame,
    policy: PlatePolicy,
    keys: tuple[str, ...] = TRACK,
    delay: str = "10 seconds",
    tolerance: str = "1 second",
) -> DataFrame:
    """``plates.stale_reason`` while results and track states arrive.

    Both streams carry ``event_time``, the time of the frame in which a result arrives or a state
    holds; times of one frame differ by at most ``tolerance``. A result waits for the state of its
    frame until the watermark (``delay`` behind the slower stream) says that none will come: it then
    goes out as ``track_missing``. Rows behind the watermark leave the join's state.
    """
    left = results.withWatermark("event_time", delay)
    right = current_state(states, keys, F.col("event_time").alias("_state_time")).withWatermark("_state_time", delay)
    right = right.withColumnsRenamed({k: f"_s_{k}" for k in (*keys, "arrive_frame")})
    on = F.expr(f"_state_time between event_time - interval {tolerance} and event_time + interval {tolerance}")
    for k in (*keys, "arrive_frame"):
        on = on & (F.col(k) == F.col(f"_s_{k}"))
    joined = left.join(right, on, "leftOuter").drop("_state_time", *(f"_s_{k}" for k in (*keys, "arrive_frame")))
    return with_stale_reason(joined, policy)


def embedding_stream(embeddings: DataFrame, keys: list[str], delay: str = "10 seconds") -> DataFrame:
    """The first embedding of each track and frame; repeated deliveries go, however they are ordered.

    Rows of one track and frame have one ``event_time``. Keys are forgotten once the watermark has
    passed them; a repeat that comes even later is dropped for its time.
    """
    return embeddings.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(keys)


EXPIRED = T.StructType(
    [
        T.StructField("target_id", T.LongType()),
        T.StructField("loss_id", T.LongType()),
        T.StructField("lost_since", T.DoubleType()),
        T.StructField("expires_at", T.DoubleType()),
    ]
)


class ExpiryProcessor(StatefulProcessor):
    """One target: its open losses, each with a timer at the end of its retention."""

    def __init__(self, retention: float) -> None:
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lost = handle.getMapState("lost", "loss_id long", "since double")
        #: Recoveries that came before the loss they end.
        self.recovered = handle.getListState("recovered", "at double")

    def _lose(self, loss: int, since: float) -> None:
        # A recovery at the very end of the retention is in time.
        if any(since < at <= since + self.retention for (at,) in self._recoveries()):
            return
        self.lost.updateValue((loss,), (since,))
        if self.retention > 0:
            self.handle.registerTimer(int((since + self.retention) * 1000))

    def _recoveries(self) -> list:
        return [tuple(r) for r in self.recovered.get()] if self.recovered.exists() else []

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for loss, since in zip(initialState["loss_id"].tolist(), initialState["lost_since"].tolist()):
            self._lose(int(loss), float(since))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        changes = sorted((at, kind, loss) for pdf in rows for at, kind, loss in zip(pdf["ts"].tolist(), pdf["change"].tolist(), pdf["loss_id"].tolist()))
        back = sorted(at for at, kind, _ in changes if kind == "recovered")
        if back:
            # Only recoveries that a loss behind the watermark's delay may still meet are kept.
            oldest = timerValues.getCurrentWatermarkInMs() / 1000.0
            self.recovered.put([(at,) for at in sorted({*(a for (a,) in self._recoveries()), *back}) if at >= oldest])
            for (loss,), (since,) in [(tuple(k), tuple(v)) for k, v in self.lost.iterator()]:
                if any(since < at <= since + self.retention or self.retention <= 0 < at - since for at in back):
                    self.lost.removeKey((loss,))
        for at, kind, loss in changes:
            if kind == "lost":
                self._lose(int(loss), float(at))
        yield pd.DataFrame(columns=EXPIRED.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for (loss,), (since,) in [(tuple(k), tuple(v)) for k, v in self.lost.iterator()]:
            if (since + self.retention) * 1000 <= now:
                self.lost.removeKey((loss,))
                out.append((key[0], loss, since, since + self.retention))
        yield pd.DataFrame(out, columns=EXPIRED.names)

    def close(self) -> None:
        pass


def expiry_stream(changes: DataFrame, retention: float, stored: DataFrame | None = None, delay: str = "10 seconds") -> DataFrame:
    """Targets whose retention runs out, when event time passes the end of it, without a row of theirs.

    ``changes``: ``target_id``, ``loss_id``, ``change`` (lost or recovered), ``ts`` in seconds and
    ``event_time``; any other change only moves the clock. ``stored``: ``target_id``, ``loss_id``,
    ``lost_since`` of targets that were lost before the stream began. A retention of zero keeps
    targets for ever.
    """
    return (
        changes.withWatermark("event_time", delay)
        .groupBy("target_id")
        .transformWithStateInPandas(
            statefulProcessor=ExpiryProcessor(retention),
            outputStructType=EXPIRED,
            outputMode="Append",
            timeMode="EventTime",
            initialState=None if stored is None else stored.groupBy("target_id"),
        )
    )


def end_rows(rows: DataFrame, keys: list[str], source: list[str]) -> DataFrame:
    """Punctuation: a row with ``end`` set for each key of a finished ``source``, at its last moment.

    Sent behind the rows themselves, it makes ``plate_stream`` count everything that still waits for
    the watermark. Columns that are not keys or times are null.
    """
    last = rows.groupBy(*source).agg(F.max("event_time").alias("event_time"), F.max("ts").alias("ts"))
    ends = rows.select(*keys).distinct().join(last, source)
    rest = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in {*keys, "event_time", "ts", "end"}]
    return ends.select("*", *rest, F.lit(True).alias("end")).select(*[c for c in rows.columns if c != "end"], "end")
