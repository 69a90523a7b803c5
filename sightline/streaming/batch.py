"""Stateful operators over stored tables: sorted, streamed folds per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sightline import policy as pol
from sightline.operators import scan
from sightline.operators.greedy import greedy_pairs, suppress  # noqa: F401
from sightline.operators.sequences import row_fold
from sightline.policy import EnrichmentPolicy, RecoveryPolicy
from sightline.streaming.steps import Bank, Fifo, Registry, Seen, Session, unit

EVENT_FIELDS = "event string, target_id bigint, track_id bigint, identity_id bigint, score double, support double"
INPUTS = [
    "track_id",
    "accepted",
    "embedding",
    "x1",
    "y1",
    "x2",
    "y2",
    "overlap",
    "partners",
    "plate",
    "command",
    "hit_ids",
    "hit_scores",
    "hit_plates",
]


def retry_cooldown(attempts: DataFrame, keys: list[str], interval: int, frame: str = "frame_index") -> DataFrame:
    """Mark which visible frames of a track are used for an attempt.

    An unmatched attempt blocks the track for ``interval`` frames.  The block is lifted
    when the track disappears and when the set of identities changes
    (``gallery_version``), so both cut a key into independent pieces.
    """
    pieces = scan.with_runs(attempts, keys, frame).drop("run_start")

    def step(state: dict, now: int, matched: bool):
        used = now >= state["until"]
        if used and not matched:
            state["until"] = now + interval
        return (used,)

    marked = row_fold(
        pieces,
        [*keys, "run_no", "gallery_version"],
        [frame],
        [frame, "matched"],
        lambda: {"until": 0},
        step,
        "attempted boolean",
    )
    return marked.drop("run_no")


def lifecycle(commands: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Outcome of every target command: select, correct, invalidate, recover, remove."""

    def step(state: Registry, command, target, track, right_class):
        outcome, held = state.apply(command, target, track, right_class)
        return outcome, held, state.lost, state.recovered

    return row_fold(
        commands,
        keys,
        order,
        ["command", "target_id", "track_id", "right_class"],
        Registry,
        step,
        "outcome string, held_target bigint, lost_count bigint, recovered_count bigint",
    )


def reference_bank(
    crops: DataFrame, keys: list[str], policy: RecoveryPolicy, frame: str = "frame_index"
) -> DataFrame:
    """Which crops of a target enter its runtime bank.

    The first usable crop starts the bank.  Later crops are tried every
    ``reference_interval`` frames (a crop of bad quality uses up its turn) and enter when
    they resemble the centroid; the bank keeps the newest ``bank_size``.  Rows with
    ``stored`` true are copied references of a known identity: they come before the first
    crop of the key, which is then added to them.
    """
    if "stored" not in crops.columns:
        crops = crops.withColumn("stored", F.lit(False))

    def step(state: dict, now: int, accepted: bool, embedding, stored: bool):
        bank, v = state["bank"], unit(embedding) if accepted or stored else None
        if stored:
            if v is not None:
                bank.add(v)
            return "stored", float("nan"), len(bank.refs)
        if state["last"] is None:
            if v is None:
                return None
            state["last"] = now
            bank.add(v)
            return "started", 1.0, len(bank.refs)
        if now - state["last"] < policy.reference_interval:
            return None
        state["last"] = now
        if v is None:
            return "rejected_quality", float("nan"), len(bank.refs)
        taken, likeness = bank.offer(v)
        return ("accepted" if taken else "rejected_likeness"), likeness, len(bank.refs)

    def start() -> dict:
        return {"bank": Fifo(policy.bank_size, policy.reference_update_threshold), "last": None}

    return row_fold(
        crops,
        keys,
        [F.desc("stored"), frame],
        [frame, "accepted", "embedding", "stored"],
        start,
        step,
        "outcome string, likeness double, bank_size bigint",
    )


def reference_turns(
    crops: DataFrame, keys: list[str], policy: RecoveryPolicy, frame: str = "frame_index", starts: str = "accepted"
) -> DataFrame:
    """The crops that :func:`reference_bank` looks at, for callers that fetch vectors for these only.

    Which crops have a turn does not depend on likeness: the first one of a key that ``starts`` (it is
    accepted and its vector is usable), then the first one ``reference_interval`` frames or more after
    the last turn.
    """

    def step(state: dict, now: int, able: bool):
        if state["last"] is None and not able:
            return None
        if state["last"] is not None and now - state["last"] < policy.reference_interval:
            return None
        state["last"] = now
        return (True,)

    return row_fold(crops, keys, [frame], [frame, starts], lambda: {"last": None}, step, "_turn boolean").drop("_turn")


def diverse_bank(offers: DataFrame, keys: list[str], order: list[str], policy: EnrichmentPolicy) -> DataFrame:
    """Fold offered vectors into the stored bank of each identity.

    Rows with ``stored`` true are the bank as it is and come first in ``order``; the
    others are offered one after another.  Invalid vectors leave the bank alone.
    """

    def step(state: Bank, stored: bool, embedding):
        v = unit(embedding)
        if v is None:
            return "invalid", -1, len(state.refs)
        if stored:
            state.refs.append(v)
            return "stored", len(state.refs) - 1, len(state.refs)
        size = len(state.refs)
        changed, index = state.offer(v)
        outcome = "unchanged" if not changed else "added" if len(state.refs) > size else "replaced"
        return outcome, index, len(state.refs)

    return row_fold(
        offers,
        keys,
        order,
        ["stored", "embedding"],
        lambda: Bank(policy),
        step,
        "outcome string, slot bigint, bank_size bigint",
    )


def make_session(domain: str, options: dict) -> Session:
    """A fresh session with the default policies, unless ``options`` replaces some."""
    people = domain == "person"
    chosen = {
        "recovery": pol.PERSON_RECOVERY if people else pol.VEHICLE_RECOVERY,
        "recognition": pol.PERSON_RECOGNITION if people else pol.VEHICLE_RECOGNITION,
        "guard_policy": pol.GUARD if people else None,
        "enrichment": pol.ENRICHMENT,
        "retention": pol.LOST_RETENTION_SECONDS,
    }
    chosen.update(options.get(domain, {}))
    return Session(domain=domain, **chosen)


def seen_row(values: tuple) -> Seen | None:
    """A visible track from its input columns; the frame's own row has no track."""
    track, ok, emb, x1, y1, x2, y2, overlap, partners, plate, command, ids, scores, plates = values
    if track is None or track != track:
        return None
    vector = unit(emb) if emb is not None else None
    near = {int(i): (s, p) for i, s, p in zip(ids, scores, plates)} if ids is not None else {}
    others = tuple(int(p) for p in partners) if partners is not None else ()
    return Seen(int(track), bool(ok), vector, (x1, y1, x2, y2), overlap, others, plate, near, command)


def session_events(inputs: DataFrame, keys: list[str], options: dict | None = None) -> DataFrame:
    """Fold the frames of every key (camera, run, ...) and domain into identity events.

    ``inputs`` has one row per visible track and one row without a track per processed
    frame (``n_identities``, ``ts`` in seconds).  Rows of a key arrive sorted and in
    batches; only the session and the current frame are held.  Add a run column to
    ``keys`` to let the runs of one camera proceed in parallel: targets never outlive a
    run.
    """
    options = options or {}
    full = [*keys, "domain"]
    types = dict(inputs.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in full) + ", frame_index bigint, " + EVENT_FIELDS
    names = [*full, "frame_index", "event", "target_id", "track_id", "identity_id", "score", "support"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, current, rows, moment = None, None, [], (0.0, 0)

        def close() -> list:
            events = session.frame(current[-1], *moment, rows) if current is not None else []
            return [(*current, *e) for e in events]

        for pdf in batches:
            out: list = []
            heads = zip(*[pdf[c].tolist() for c in [*full, "frame_index"]])
            moments = zip(pdf["ts"].tolist(), pdf["n_identities"].tolist())
            for head, when, values in zip(heads, moments, zip(*[pdf[c].tolist() for c in INPUTS])):
                if head != current:
                    out += close()
                    if current is None or head[:-1] != current[:-1]:
                        session = make_session(head[-2], options)
                    # A new list: the closed frame's rows may still be referenced.
                    current, rows, moment = head, [], when
                row = seen_row(values)
                if row is not None:
                    rows.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(close(), columns=names)

    ordered = inputs.repartition(*full).sortWithinPartitions(*full, "frame_index", "track_id")
    return ordered.mapInPandas(run, schema)
