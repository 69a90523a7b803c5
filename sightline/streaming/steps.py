"""What one frame does to the session targets of one camera and domain.

Everything that does not depend on earlier frames is a column when it gets here: quality,
overlap partners, plates, and the stored identities a crop resembles (``hits``, scored in
blocks beforehand).  What is left is a little state per camera: which target follows which
track, a bounded bank of vectors per target, and counters.  ``Session.frame`` is used
unchanged by the batch fold and by the stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from sightline.policy import EnrichmentPolicy, GuardPolicy, RecognitionPolicy, RecoveryPolicy


class Seen(NamedTuple):
    """One visible track of the frame."""

    track: int
    accepted: bool
    vector: np.ndarray | None
    box: tuple
    overlap: float
    partners: tuple
    plate: str | None
    hits: dict
    command: str | None


class Event(NamedTuple):
    event: str
    target: int = -1
    track: int = -1
    identity: int = -1
    score: float = float("nan")
    support: float = float("nan")


@dataclass
class Target:
    track: int | None
    last_track: int
    refs: list
    centroid: np.ndarray
    last_ref: int
    lost: bool = False
    missing: int = 0
    last_try: int | None = None
    lost_since: float | None = None
    identity: int | None = None
    plate: str | None = None
    opted: bool = False
    explicit: bool = False
    blocked: bool = False
    stable: int = 0


@dataclass
class Sweep:
    tracks: list
    owners: frozenset
    cursor: int = 0
    found: dict = field(default_factory=dict)
    protected: set = field(default_factory=set)

    def take(self, budget: int) -> list:
        part = self.tracks[self.cursor : self.cursor + budget]
        self.cursor += len(part)
        return part

    @property
    def done(self) -> bool:
        return self.cursor >= len(self.tracks)


def unit(v) -> np.ndarray | None:
    v = np.asarray(v, dtype=np.float64)
    n = np.sqrt(v @ v) if v.size else 0.0
    return v / n if np.isfinite(n) and n > 1.1920928955078125e-07 else None


def cosine(a: np.ndarray, b: np.ndarray) -> float | None:
    return float(a @ b) if a.shape == b.shape else None


def top_support(refs: list, v: np.ndarray, k: int) -> float:
    best = sorted((s for r in refs if (s := cosine(r, v)) is not None), reverse=True)[:k]
    return sum(best) / len(best) if best else float("-inf")


def claim(scores: dict, threshold: float, margin: float, enough=None, later_wins: bool = False) -> list:
    """Mutually clear best pairs ``(owner, track, score)`` of a sparse score table."""
    by_owner: dict = {}
    by_track: dict = {}
    for (owner, track), s in scores.items():
        by_owner.setdefault(owner, []).append((s, track))
        by_track.setdefault(track, []).append(s)
    proposals = []
    for owner, row in by_owner.items():
        row.sort(key=lambda x: (-x[0], -x[1] if later_wins else x[1]))
        best, track = row[0]
        if best < threshold or (enough is not None and not enough(owner, track)):
            continue
        rivals = sorted(by_track[track], reverse=True)
        clear = len(row) == 1 or best - row[1][0] >= margin
        if clear and (len(rivals) == 1 or best - rivals[1] >= margin):
            proposals.append((best, owner, track))
    taken, result = set(), []
    for best, owner, track in sorted(proposals, key=lambda p: (-p[0], p[1], p[2])):
        if track not in taken:
            taken.add(track)
            result.append((owner, track, best))
    return result


def shape(box) -> tuple | None:
    """width, area, centre and diagonal of a box with a positive area."""
    x1, y1, x2, y2 = box
    w, h = x2 - x1, y2 - y1
    if not np.isfinite([x1, y1, x2, y2]).all() or w <= 0 or h <= 0:
        return None
    return w, w * h, (x1 + x2) / 2, (y1 + y2) / 2, float(np.hypot(w, h))


def is_anomalous(now: tuple, history: list, p: GuardPolicy) -> bool:
    if p.overlap_alone:
        return True
    if not history:
        return False
    w, a, x, y, diagonal = (max(float(m), 1e-6) if i in (0, 1, 4) else float(m) for i, m in enumerate(np.median(history, axis=0)))
    shift = float(np.hypot(now[2] - x, now[3] - y)) / diagonal
    return now[0] / w > p.max_width_growth or now[1] / a > p.max_area_growth or shift > p.max_center_shift


@dataclass
class Session:
    """Targets of one camera and domain during one run."""

    domain: str
    recovery: RecoveryPolicy
    recognition: RecognitionPolicy
    guard_policy: GuardPolicy | None
    enrichment: EnrichmentPolicy
    retention: float = 0.0
    targets: dict = field(default_factory=dict)
    next_id: int = 1
    ages: dict = field(default_factory=dict)
    # Frames of a track's age that no longer count for recognition.
    discount: dict = field(default_factory=dict)
    waiting: dict = field(default_factory=dict)
    sweep: Sweep | None = None
    naming: dict = field(default_factory=dict)
    naming_sweep: Sweep | None = None
    naming_last: int | None = None
    retry: dict = field(default_factory=dict)
    guards: dict = field(default_factory=dict)

    def frame(self, now: int, ts: float, n_identities: int, rows: list[Seen]) -> list[Event]:
        """Guard, recovery, enrichment, recognition and expiry, in that order."""
        seen = {r.track: r for r in rows}
        out: list[Event] = []
        self._age(now, seen)
        self._commands(now, seen, out)
        blocked = self._guard(ts, seen, out) if self.guard_policy else set()
        updates = self._visibility_and_banks(now, ts, seen, blocked, out)
        recovered = self._recover(now, seen, out)
        self._carry_plates(seen)
        self._enrich(now, updates, out)
        self._recognize(now, seen, recovered, n_identities, out)
        self._expire(ts, out)
        return out

    def _owner(self, track: int) -> int | None:
        for tid, t in self.targets.items():
            if t.track == track:
                return tid
        return None

    def _named(self, track: int) -> bool:
        tid = self._owner(track)
        return tid is not None and self.targets[tid].identity is not None

    def _age(self, now: int, seen: dict) -> None:
        for track in [t for t in self.ages if t not in seen]:
            del self.ages[track]
            self.retry.pop(track, None)
            self.discount.pop(track, None)
            for book in (self.waiting, self.naming):
                for key in [k for k in book if k[1] == track]:
                    del book[key]
        for track in seen:
            age, last = self.ages.get(track, (0, now - 1))
            self.ages[track] = (age + 1 if last == now - 1 else 1, now)

    def _create(self, now: int, track: int, vector: np.ndarray) -> int:
        tid, self.next_id = self.next_id, self.next_id + 1
        self.targets[tid] = Target(track, track, [vector], vector, now)
        return tid

    def _commands(self, now: int, seen: dict, out: list) -> None:
        for r in seen.values():
            tid = self._owner(r.track)
            if r.command == "select" and tid is None and r.accepted and r.vector is not None:
                out.append(Event("selected", self._create(now, r.track, r.vector), r.track))
            elif r.command == "remove" and tid is not None:
                del self.targets[tid]
                self.guards.pop(tid, None)
                self._store_changed()
                out.append(Event("removed", tid, r.track))
            elif r.command and r.command.startswith("enroll:") and tid is not None:
                t = self.targets[tid]
                if t.identity is None:
                    t.identity = int(r.command.split(":")[1])
                if not t.explicit:
                    t.explicit, t.blocked, t.stable = True, False, self.enrichment.stable_frames
                self._store_changed()
                out.append(Event("enrolled", tid, r.track, t.identity))

    def _guard(self, ts: float, seen: dict, out: list) -> set:
        p, q, blocked = self.guard_policy, self.recovery, set()
        self.guards = {k: g for k, g in self.guards.items() if k in self.targets and not self.targets[k].lost}
        for tid, t in list(self.targets.items()):
            r = seen.get(t.track) if not t.lost else None
            now = shape(r.box) if r else None
            if now is None:
                continue
            g = self.guards.get(tid)
            if g is None or g["track"] != t.track:
                g = self.guards[tid] = {"track": t.track, "history": [], "suspects": (), "best": None, "hits": 0, "fails": 0}
            if not g["suspects"]:
                odd = is_anomalous(now, g["history"], p)
                if odd and r.overlap >= p.overlap_trigger:
                    g.update(suspects=(t.track, *r.partners[: p.max_candidates - 1]), best=None, hits=0, fails=0)
                    blocked.add(tid)
                    out.append(Event("ambiguous", tid, t.track))
                elif r.accepted and not odd:
                    g["history"] = [*g["history"], now][-p.history :]
                continue
            blocked.add(tid)
            if r.overlap >= p.overlap_clear:
                continue
            scored = []
            for track in g["suspects"]:
                c = seen.get(track)
                if c is None or not c.accepted or c.vector is None or self._owner(track) not in (None, tid):
                    continue
                s = cosine(t.centroid, c.vector)
                if s is not None:
                    scored.append((-s, track, top_support(t.refs, c.vector, q.support_top_k)))
            if not scored:
                g.update(best=None, hits=0, fails=0)
                continue
            scored.sort()
            best, track, support = -scored[0][0], scored[0][1], scored[0][2]
            clear = len(scored) == 1 or best + scored[1][0] >= q.margin
            if best >= q.threshold and support >= q.support_threshold and clear:
                g.update(hits=g["hits"] + 1 if g["best"] == track else 1, best=track, fails=0)
                if g["hits"] >= p.hits:
                    if track != t.track:
                        t.track = t.last_track = track
                        t.missing = 0
                        out.append(Event("corrected", tid, track, score=best, support=support))
                    self.guards[tid] = {"track": track, "history": [now] if track == r.track else [], "suspects": (), "best": None, "hits": 0, "fails": 0}
            else:
                g.update(best=None, hits=0, fails=g["fails"] + 1)
                if g["fails"] >= p.hits:
                    out.append(Event("identity_lost", tid, t.track))
                    t.track, t.lost, t.missing, t.last_try, t.lost_since = None, True, 0, None, ts
                    del self.guards[tid]
        return blocked

    def _visibility_and_banks(self, now: int, ts: float, seen: dict, blocked: set, out: list) -> list:
        p, updates = self.recovery, []
        self.waiting = {k: v for k, v in self.waiting.items() if now - v[1] <= p.pending_max_age}
        for tid, t in self.targets.items():
            if t.lost:
                continue
            r = seen.get(t.track)
            if r is None:
                t.missing += 1
                if t.missing >= p.lost_grace_frames:
                    out.append(Event("lost", tid, t.track))
                    t.last_track, t.track, t.lost, t.last_try, t.lost_since = t.track, None, True, None, ts
                continue
            t.missing, t.last_track = 0, t.track
            if tid in blocked or now - t.last_ref < p.reference_interval:
                continue
            t.last_ref = now
            s = cosine(t.centroid, r.vector) if r.accepted and r.vector is not None else None
            if s is not None and s >= p.reference_update_threshold:
                t.refs = [*t.refs, r.vector][-p.bank_size :]
                t.centroid = unit(np.mean(t.refs, axis=0))
                updates.append(tid)
                out.append(Event("reference_updated", tid, t.track, score=s))
        return updates

    def _recover(self, now: int, seen: dict, out: list) -> set:
        p = self.recovery
        free = [k for k in seen if self._owner(k) is None]
        if self.sweep is None:
            due = [k for k, t in self.targets.items() if t.lost and (t.last_try is None or now - t.last_try >= p.interval)]
            tracks = sorted((k for k in free if self.ages[k][0] >= p.min_age), key=lambda k: (self.ages[k][0], k))
            if due and tracks:
                self.sweep = Sweep(tracks, frozenset(due))
                for tid in due:
                    self.targets[tid].last_try = now
        sweep = self.sweep
        if sweep is None:
            return set()
        for track in sweep.take(p.budget):
            r = seen.get(track)
            if r is not None and r.accepted and r.vector is not None:
                sweep.found[track] = r.vector
        if not sweep.done:
            return set()
        self.sweep = None
        lost = [k for k in sweep.owners if k in self.targets and self.targets[k].lost]
        cands = {k: v for k, v in sweep.found.items() if k in free}
        if not lost or not cands:
            return set()
        scores = {}
        for tid in lost:
            t = self.targets[tid]
            for track, v in cands.items():
                if t.plate and seen[track].plate and t.plate != seen[track].plate:
                    continue
                s = cosine(t.centroid, v)
                if s is not None:
                    scores[tid, track] = s
        position = {track: i for i, track in enumerate(cands)}

        def support(tid: int, track: int) -> float:
            return top_support(self.targets[tid].refs, cands[track], p.support_top_k)

        # Equal scores prefer the candidate that was examined later.
        indexed = {(tid, position[track]): s for (tid, track), s in scores.items()}
        names = list(cands)
        found = claim(indexed, p.threshold, p.margin, lambda o, i: support(o, names[i]) >= p.support_threshold, True)
        matches = {(tid, names[i]): s for tid, i, s in found}
        self.waiting = {k: v for k, v in self.waiting.items() if k[0] not in lost or k in matches}
        recovered = set()
        for (tid, track), s in matches.items():
            hits = self.waiting.get((tid, track), (0, now))[0] + 1
            if hits < p.hits:
                self.waiting[tid, track] = (hits, now)
                out.append(Event("recovery_pending", tid, track, score=s, support=support(tid, track)))
                continue
            self.waiting.pop((tid, track), None)
            t = self.targets[tid]
            t.track = t.last_track = track
            t.lost, t.missing, t.last_try, t.lost_since = False, 0, now, None
            recovered.add(track)
            identity = -1 if t.identity is None else t.identity
            out.append(Event("recovered", tid, track, identity, s, support(tid, track)))
        return recovered

    def _carry_plates(self, seen: dict) -> None:
        """The first plate known for a target stays with it across tracks."""
        for t in self.targets.values():
            if t.plate is None and t.track in seen:
                t.plate = seen[t.track].plate

    def _enrich(self, now: int, updates: list, out: list) -> None:
        """Advance the cooldowns, then offer fresh references of named targets to the store."""
        people = self.domain == "person"
        for t in self.targets.values():
            if people and t.explicit and t.lost:
                t.blocked, t.stable = True, 0
            if not t.blocked or (people and not t.explicit):
                continue
            if t.lost or t.missing > 0 or t.last_try == now:
                t.stable = 0
                continue
            t.stable += 1
            t.blocked = t.stable < self.enrichment.stable_frames
        for tid in updates:
            t = self.targets[tid]
            if t.identity is not None and not t.blocked and (t.explicit or not people):
                out.append(Event("enrichment", tid, t.track, t.identity))

    def _recognize(self, now: int, seen: dict, protected: set, n_identities: int, out: list) -> None:
        p = self.recognition
        attached = {t.identity for t in self.targets.values() if t.identity is not None}
        # Newly enrolled identities have not opted in, so they are no loss to the free ones.
        free = n_identities - sum(t.opted for t in self.targets.values())

        def age(track: int) -> int:
            return self.ages[track][0] - self.discount.get(track, 0)

        def eligible(shielded: set) -> list:
            ok = [
                k
                for k in seen
                if age(k) >= p.min_age and k not in shielded and not self._named(k) and now >= self.retry.get(k, now)
            ]
            return sorted(ok, key=lambda k: (age(k), k))

        sweep = self.naming_sweep
        if sweep is None:
            due = self.naming_last is None or now - self.naming_last >= p.interval
            tracks = eligible(protected) if due and free > 0 else []
            if not tracks:
                return
            self.naming_last = now
            sweep = self.naming_sweep = Sweep(tracks, frozenset(attached))
        sweep.protected |= protected
        sweep.tracks += [k for k in eligible(sweep.protected) if k not in sweep.tracks]
        for track in sweep.take(p.budget):
            r = seen.get(track)
            if r is None or track in sweep.protected or self._named(track):
                continue
            if r.accepted and r.vector is not None:
                sweep.found[track] = r
        if not sweep.done:
            return
        self.naming_sweep = None
        cands = {k: r for k, r in sweep.found.items() if k in seen and k not in sweep.protected and not self._named(k)}
        taken = sweep.owners | attached
        if not cands or free <= 0:
            return
        # Two plates that are known and differ rule a pair out before any margin is looked at.
        scores = {
            (i, k): s
            for k, r in cands.items()
            for i, (s, plate) in r.hits.items()
            if i not in taken and not (r.plate and plate and r.plate != plate)
        }
        matches = {(i, k): s for i, k, s in claim(scores, p.threshold, p.margin)}
        named = {k for _, k in matches}
        self.naming = {k: v for k, v in self.naming.items() if k[1] not in cands or k in matches}
        for track in cands.keys() - named:
            self.retry[track] = now + p.retry_interval
        for (identity, track), s in matches.items():
            hits = self.naming.get((identity, track), (0, now))[0] + 1
            if hits < p.hits:
                self.naming[identity, track] = (hits, now)
                out.append(Event("recognition_pending", -1, track, identity, s))
                continue
            self.naming.pop((identity, track), None)
            tid = self._owner(track)
            if tid is None:
                tid = self._create(now, track, cands[track].vector)
            t = self.targets[tid]
            t.identity, t.opted = identity, True
            t.plate = t.plate or cands[track].hits[identity][1]
            if self.domain == "vehicle" and not t.explicit:
                t.blocked, t.stable = True, 0
            out.append(Event("recognized", tid, track, identity, s))

    def _expire(self, ts: float, out: list) -> None:
        if self.retention <= 0:
            return
        old = [k for k, t in self.targets.items() if t.lost and ts - t.lost_since >= self.retention]
        for tid in old:
            t = self.targets[tid]
            out.append(Event("expired", tid, t.last_track, -1 if t.identity is None else t.identity))
            self._forget(tid)
        if old:
            self._store_changed()

    def _store_changed(self) -> None:
        """Identities became free or taken: everybody may be tried again at once."""
        self.retry.clear()
        attached = {t.identity for t in self.targets.values()}
        self.naming = {k: v for k, v in self.naming.items() if k[0] not in attached}

    def _forget(self, tid: int) -> None:
        """Remove a target with everything that was kept for it or for its last track."""
        t = self.targets.pop(tid)
        self.guards.pop(tid, None)
        self.waiting = {k: v for k, v in self.waiting.items() if k[0] != tid}
        if self.sweep is not None:
            self.sweep.owners = self.sweep.owners - {tid}
            if not self.sweep.owners:
                self.sweep = None
        if t.last_track in self.ages:
            self.discount[t.last_track] = self.ages[t.last_track][0]
        self.retry.pop(t.last_track, None)
        self.naming = {k: v for k, v in self.naming.items() if k[1] != t.last_track}
        if self.naming_sweep is not None and t.last_track in self.naming_sweep.tracks:
            self.naming_sweep = None


class Bank:
    """Stored references of one identity, kept diverse; the first one is never replaced."""

    def __init__(self, policy: EnrichmentPolicy) -> None:
        self.policy = policy
        self.refs: list = []

    def offer(self, v: np.ndarray) -> tuple[bool, int]:
        """``(changed, index)`` of the reference that was added or replaced."""
        if not self.refs:
            self.refs.append(v)
            return True, 0
        near = [float(r @ v) for r in self.refs]
        if max(near) >= self.policy.duplicate_threshold:
            return False, -1
        if len(self.refs) < self.policy.bank_size:
            self.refs.append(v)
            return True, len(self.refs) - 1
        if len(self.refs) == 1:
            return False, -1
        m = np.stack(self.refs)
        table = m @ m.T
        np.fill_diagonal(table, -np.inf)
        worst = table.max(axis=1)
        victim = 1 + int(worst[1:].argmax())
        if max(near) >= worst[victim]:
            return False, -1
        self.refs[victim] = v
        return True, victim


class Fifo:
    """Runtime references of one target: newest ones, admitted by likeness to their mean."""

    def __init__(self, size: int, threshold: float) -> None:
        self.size, self.threshold = size, threshold
        self.refs: list = []
        self.centroid: np.ndarray | None = None

    def add(self, v: np.ndarray) -> None:
        self.refs = [*self.refs, v][-self.size :]
        self.centroid = unit(np.mean(self.refs, axis=0))

    def offer(self, v: np.ndarray) -> tuple[bool, float]:
        s = 1.0 if self.centroid is None else cosine(self.centroid, v)
        if s is None or s < self.threshold:
            return False, float("nan") if s is None else s
        self.add(v)
        return True, s


class Registry:
    """Direct changes of targets with their refusals; counts what was lost and recovered."""

    def __init__(self) -> None:
        self.targets: dict = {}
        self.next_id, self.lost, self.recovered = 1, 0, 0

    def owner(self, track: int) -> int | None:
        return next((k for k, v in self.targets.items() if v == ("ACTIVE", track)), None)

    def apply(self, command: str, target: int, track: int, right_class: bool) -> tuple[str, int]:
        """``(outcome, target)`` of one command."""
        if command == "select":
            held = self.owner(track)
            if held is not None:
                return "already_selected", held
            target, self.next_id = self.next_id, self.next_id + 1
            self.targets[target] = ("ACTIVE", track)
            return "selected", target
        if command == "remove":
            held = self.owner(track)
            if held is None:
                return "not_selected", -1
            del self.targets[held]
            return "removed", held
        if target not in self.targets:
            return "unknown_target", target
        state, _ = self.targets[target]
        wanted = "LOST" if command == "recover" else "ACTIVE"
        if state != wanted:
            return f"not_{wanted.lower()}", target
        if command == "invalidate":
            self.targets[target] = ("LOST", None)
            self.lost += 1
            return "invalidated", target
        if command == "correct" and not right_class:
            return "wrong_class", target
        if self.owner(track) not in (None, target):
            return "track_occupied", target
        self.targets[target] = ("ACTIVE", track)
        if command == "recover":
            self.recovered += 1
        return ("recovered" if command == "recover" else "corrected"), target
