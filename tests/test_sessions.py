"""Frame steps on hand-made sequences."""

from dataclasses import replace

import numpy as np
import pytest

from sightline import policy as pol
from sightline.streaming.steps import Bank, Registry, Seen, Session, claim, top_support, unit

HERE = (50.0, 50.0, 130.0, 250.0)


def basis(i, n=16):
    v = np.zeros(n)
    v[i] = 1.0
    return v


def seen(track, vector=None, *, accepted=True, box=HERE, overlap=0.0, partners=(), plate=None, hits=None, command=None):
    v = None if vector is None else unit(vector)
    return Seen(track, accepted, v, box, overlap, partners, plate, hits or {}, command)


def session(domain="person", retention=0.0, guard=None, recovery=None, recognition=None, stable=30):
    rec = dict(
        lost_grace_frames=1, reference_interval=15, interval=1, bank_size=3, threshold=0.8, margin=0.05,
        reference_update_threshold=0.8, support_threshold=0.8, support_top_k=3, min_age=1, hits=1, pending_max_age=60,
    )
    rec.update(recovery or {})
    nam = dict(interval=1, min_age=1, threshold=0.8, margin=0.05, hits=1, budget=3, retry_interval=15)
    nam.update(recognition or {})
    return Session(
        domain,
        replace(pol.PERSON_RECOVERY, **rec),
        replace(pol.PERSON_RECOGNITION, **nam),
        guard,
        pol.EnrichmentPolicy(stable_frames=stable),
        retention,
    )


def run(s, frame, *rows, n=0, ts=None):
    return [(e.event, e.target, e.track) for e in s.frame(frame, frame if ts is None else ts, n, list(rows))]


def test_select_lose_and_recover_keeps_the_target():
    s = session()
    assert run(s, 0, seen(3, [1, 0], command="select")) == [("selected", 1, 3)]
    assert run(s, 1) == [("lost", 1, 3)]
    assert s.targets[1].last_track == 3 and s.targets[1].track is None
    assert run(s, 2, seen(8, [0.98, 0.2])) == [("recovered", 1, 8)]
    # The recovery crop itself teaches nothing.
    assert len(s.targets[1].refs) == 1 and np.allclose(s.targets[1].centroid, [1, 0])


def test_selecting_twice_and_bad_crops():
    s = session()
    run(s, 0, seen(3, [1, 0], command="select"))
    assert run(s, 1, seen(3, [1, 0], command="select")) == []
    assert run(s, 2, seen(3, [1, 0]), seen(4, None, accepted=False, command="select")) == []
    assert len(s.targets) == 1


def test_short_absence_is_no_loss():
    s = session(recovery={"lost_grace_frames": 2})
    run(s, 0, seen(3, [1, 0], command="select"))
    assert run(s, 1) == [] and not s.targets[1].lost
    assert run(s, 2, seen(3, [1, 0])) == [] and s.targets[1].missing == 0


def test_references_are_gated_and_bounded():
    s = session(recovery={"reference_interval": 1})
    run(s, 0, seen(3, [1, 0], command="select"))
    assert run(s, 1, seen(3, [0, 1])) == []
    assert run(s, 2, seen(3, [1, 0], accepted=False)) == []
    for f in range(3, 8):
        assert run(s, f, seen(3, [1, 0.1])) == [("reference_updated", 1, 3)]
    assert len(s.targets[1].refs) == 3


def test_two_hits_are_needed_and_a_failure_clears_them():
    s = session(recovery={"hits": 2})
    run(s, 0, seen(3, [1, 0], command="select"))
    run(s, 1)
    assert run(s, 2, seen(8, [1, 0])) == [("recovery_pending", 1, 8)]
    assert run(s, 3, seen(8, [0, 1])) == [] and s.waiting == {}
    assert run(s, 4, seen(8, [1, 0])) == [("recovery_pending", 1, 8)]
    assert run(s, 5, seen(8, [1, 0])) == [("recovered", 1, 8)]


def test_pending_ends_with_age_and_absence():
    s = session(recovery={"hits": 2, "interval": 100, "pending_max_age": 5})
    run(s, 0, seen(3, [1, 0], command="select"))
    run(s, 1)
    run(s, 2, seen(8, [1, 0]))
    for f in range(3, 8):
        run(s, f, seen(8, [1, 0]))
        assert s.waiting
    run(s, 8, seen(8, [1, 0]))
    assert not s.waiting


def test_strangers_and_ambiguous_candidates_stay_out():
    s = session(recovery={"threshold": 0.85, "budget": 8})
    run(s, 0, seen(3, [1, 0], command="select"))
    run(s, 1)
    assert run(s, 2, seen(8, [0.84, (1 - 0.84**2) ** 0.5])) == []
    assert run(s, 3, seen(9, [1, 0.01]), seen(10, [1, 0.02])) == []


def test_sweep_spreads_over_frames_and_matches_at_its_end():
    s = session(recovery={"budget": 3, "interval": 50})
    run(s, 0, seen(1, basis(0), command="select"))
    run(s, 1)
    rows = [seen(100 + i, basis(i + 1 if i else 0)) for i in range(7)]
    assert run(s, 2, *rows) == []
    assert s.sweep.cursor == 3
    assert run(s, 3, *rows) == []
    assert run(s, 4, *rows) == [("recovered", 1, 100)]


def test_no_candidates_costs_no_interval():
    s = session(recovery={"min_age": 3, "interval": 50})
    run(s, 0, seen(1, [1, 0], command="select"))
    run(s, 1)
    assert run(s, 2, seen(5, [1, 0])) == [] and s.targets[1].last_try is None
    assert run(s, 3, seen(5, [1, 0])) == []
    assert run(s, 4, seen(5, [1, 0])) == [("recovered", 1, 5)]


def test_plates_forbid_a_recovery():
    s = session("vehicle")
    run(s, 0, seen(1, [1, 0], plate="A", command="select"))
    run(s, 1)
    assert run(s, 2, seen(2, [1, 0], plate="B")) == []
    assert run(s, 3, seen(2, [1, 0], plate=None)) == [("recovered", 1, 2)]
    assert s.targets[1].plate == "A"


HIT, MISS = {1: (0.95, None)}, {}


def test_recognition_budget_three_three_one():
    s = session()
    rows = [seen(i, [1, 0], hits=HIT if i == 1 else MISS) for i in range(1, 8)]
    assert run(s, 0, *rows, n=1) == [] and s.naming_sweep.cursor == 3
    assert run(s, 1, *rows, n=1) == [] and s.naming_sweep.cursor == 6
    assert run(s, 2, *rows, n=1) == [("recognized", 1, 1)]
    assert s.targets[1].identity == 1


def test_recognition_confirms_over_whole_sweeps():
    s = session(recognition={"budget": 1, "hits": 2})
    rows = [seen(1, [1, 0], hits=HIT), seen(2, [0, 1]), seen(3, [0, 1])]
    assert run(s, 0, *rows, n=1) == [] and s.naming == {}
    assert run(s, 1, *rows, n=1) == [] and s.naming == {}
    assert run(s, 2, *rows, n=1) == [("recognition_pending", -1, 1)]
    # The other two wait out their cooldown, so the next sweep has one track.
    assert run(s, 3, *rows, n=1) == [("recognized", 1, 1)]


def test_cooldown_of_unmatched_tracks():
    s = session()
    run(s, 0, seen(1, [0, 1]), n=1)
    assert s.retry == {1: 15}
    for f in range(1, 15):
        run(s, f, seen(1, [0, 1], hits=HIT), n=1)
    assert s.targets == {}
    assert run(s, 15, seen(1, [0, 1], hits=HIT), n=1) == [("recognized", 1, 1)]


def test_bad_quality_is_no_failed_attempt():
    s = session()
    run(s, 0, seen(1, None, accepted=False), n=1)
    assert s.retry == {}
    assert run(s, 1, seen(1, [1, 0], hits=HIT), n=1) == [("recognized", 1, 1)]


def test_disappearing_clears_the_cooldown():
    s = session()
    run(s, 0, seen(1, [0, 1]), n=1)
    run(s, 1, n=1)
    assert s.retry == {}


def test_sweep_takes_in_tracks_that_come_of_age():
    s = session(recognition={"budget": 1, "min_age": 2})
    run(s, 0, seen(1, [0, 1]), n=1)
    run(s, 1, seen(1, [0, 1]), seen(2, [0, 1]), n=1)
    s.retry.clear()
    run(s, 2, seen(1, [0, 1]), seen(2, [1, 0], hits=HIT), seen(3, [0, 1]), n=1)
    assert s.naming_sweep is not None and s.naming_sweep.tracks == [2, 1]
    run(s, 3, seen(1, [0, 1]), seen(2, [1, 0], hits=HIT), seen(3, [0, 1]), n=1)
    assert s.naming_sweep.tracks == [2, 1, 3]


def test_taken_identities_are_not_given_twice():
    s = session()
    assert run(s, 0, seen(1, [1, 0], hits=HIT), n=1) == [("recognized", 1, 1)]
    assert run(s, 1, seen(1, [1, 0], hits=HIT), seen(2, [1, 0], hits=HIT), n=2) == []


def test_recovered_track_is_protected_from_recognition():
    s = session()
    run(s, 0, seen(1, [1, 0], command="select"))
    run(s, 1)
    assert run(s, 2, seen(2, [1, 0], hits=HIT), n=1) == [("recovered", 1, 2)]
    # It is still unnamed, so the next sweep may name the target it belongs to.
    assert run(s, 3, seen(2, [1, 0], hits=HIT), n=1) == [("recognized", 1, 2)]


def test_retention_ends_exactly_at_the_limit():
    s = session(retention=600.0)
    run(s, 0, seen(1, [1, 0], command="select"), ts=0.0)
    run(s, 1, ts=10.0)
    assert run(s, 2, ts=609.9) == []
    assert run(s, 3, ts=610.0) == [("expired", 1, 1)]
    assert s.targets == {}


def test_recovery_wins_at_the_deadline():
    s = session(retention=600.0)
    run(s, 0, seen(1, [1, 0], command="select"), ts=0.0)
    run(s, 1, ts=10.0)
    assert run(s, 2, seen(9, [1, 0]), ts=610.0) == [("recovered", 1, 9)]


def test_zero_retention_keeps_for_ever():
    s = session(retention=0.0)
    run(s, 0, seen(1, [1, 0], command="select"), ts=0.0)
    run(s, 1, ts=1.0)
    assert run(s, 2, ts=1e9) == [] and 1 in s.targets


GUARD = pol.GuardPolicy()
WIDE = (50.0, 50.0, 180.0, 250.0)
AWAY = (180.0, 50.0, 260.0, 250.0)


def ambiguous(s):
    run(s, 0, seen(11, basis(0), command="select"))
    run(s, 1, seen(11, basis(0)))
    return run(s, 2, seen(11, basis(0), box=WIDE, overlap=0.9, partners=(12,)), seen(12, basis(1)))


def test_guard_needs_overlap_and_growth():
    s = session(guard=GUARD)
    assert ambiguous(s) == [("ambiguous", 1, 11)]
    calm = session(guard=GUARD)
    run(calm, 0, seen(11, basis(0), command="select"))
    assert run(calm, 1, seen(11, basis(0), box=WIDE, overlap=0.1)) == []
    calm = session(guard=GUARD)
    run(calm, 0, seen(11, basis(0), command="select"))
    assert run(calm, 1, seen(11, basis(0), overlap=0.9, partners=(12,))) == []


def test_guard_with_overlap_alone():
    s = session(guard=replace(GUARD, overlap_alone=True))
    assert run(s, 0, seen(11, basis(0), overlap=0.2, partners=(12,), command="select")) == [
        ("selected", 1, 11), ("ambiguous", 1, 11)
    ]


def test_guard_waits_then_corrects_after_two_clean_frames():
    s = session(guard=GUARD)
    ambiguous(s)
    swapped = [seen(11, basis(1), box=AWAY), seen(12, basis(0))]
    crossed = [seen(11, basis(1), box=AWAY, overlap=0.10), seen(12, basis(0))]
    assert run(s, 3, *crossed) == []
    assert run(s, 4, *swapped) == []
    assert run(s, 5, *swapped) == [("corrected", 1, 12)]
    assert s.targets[1].track == 12 and not s.targets[1].lost


def test_guard_gives_up_after_two_clean_failures():
    s = session(guard=GUARD, recovery={"interval": 100, "min_age": 99})
    ambiguous(s)
    wrong = [seen(11, basis(1), box=AWAY), seen(12, basis(2))]
    assert run(s, 3, *wrong) == []
    assert run(s, 4, *wrong) == [("identity_lost", 1, 11)]
    assert s.targets[1].lost and s.targets[1].track is None


def test_guard_blocks_references_while_unsure():
    s = session(guard=GUARD, recovery={"reference_interval": 1})
    ambiguous(s)
    blocked = run(s, 3, seen(11, basis(0), overlap=0.5), seen(12, basis(1)))
    assert blocked == []


def test_people_enrich_only_after_enrollment_and_calm():
    s = session(recovery={"reference_interval": 1}, stable=2)
    run(s, 0, seen(1, [1, 0], command="select"))
    assert run(s, 1, seen(1, [1, 0])) == [("reference_updated", 1, 1)]
    assert ("enrichment", 1, 1) in run(s, 2, seen(1, [1, 0], command="enroll:5"))
    run(s, 3)  # lost
    assert run(s, 4, seen(2, [1, 0])) == [("recovered", 1, 2)]
    assert ("enrichment", 1, 2) not in run(s, 5, seen(2, [1, 0]))
    assert ("enrichment", 1, 2) in run(s, 6, seen(2, [1, 0]))


def test_vehicles_enrich_without_enrollment_after_naming():
    s = session("vehicle", recovery={"reference_interval": 1}, stable=2)
    assert run(s, 0, seen(1, [1, 0], hits=HIT), n=1) == [("recognized", 1, 1)]
    assert ("enrichment", 1, 1) not in run(s, 1, seen(1, [1, 0]))
    assert ("enrichment", 1, 1) in run(s, 2, seen(1, [1, 0]))


def test_enrolled_identities_have_not_opted_in():
    s = session()
    run(s, 0, seen(1, [1, 0], command="select"))
    run(s, 1, seen(1, [1, 0], command="enroll:9"))
    # One identity has opted in and is free, although another one is attached.
    assert run(s, 2, seen(1, [1, 0]), seen(2, [1, 0], hits=HIT), n=1) == [("recognized", 2, 2)]


def test_claims_are_one_to_one():
    scores = {(1, 11): 0.95, (1, 12): 0.31, (2, 11): 0.31, (2, 12): 0.95}
    assert [(o, t) for o, t, _ in claim(scores, 0.75, 0.10)] == [(1, 11), (2, 12)]
    assert claim({(1, 11): 1.0, (1, 12): 1.0, (2, 11): 1.0, (2, 12): 1.0}, 0.75, 0.05) == []
    assert claim({(1, 11): 0.9}, 0.75, 0.2) == [(1, 11, 0.9)]


def test_support_uses_what_there_is():
    assert top_support([basis(0), unit([0.8, 0.6] + [0] * 14)], basis(0), 3) == pytest.approx(0.9)


def near(a, b, w=0.05):
    return unit(basis(a) + w * basis(b))


def bank(refs, size=8, duplicate=0.97):
    b = Bank(pol.EnrichmentPolicy(bank_size=size, duplicate_threshold=duplicate))
    b.refs = list(refs)
    return b


def test_bank_refuses_duplicates():
    b = bank([basis(i) for i in range(8)])
    assert b.offer(near(7, 8, 0.02)) == (False, -1)


def test_bank_replaces_the_most_redundant_but_the_anchor():
    b = bank([basis(0), near(1, 2), near(1, 2, 0.06), basis(3), basis(4), basis(5), basis(6), basis(7)])
    changed, slot = b.offer(basis(8))
    assert changed and slot == 1 and np.allclose(b.refs[0], basis(0))


def test_bank_of_one_keeps_its_anchor():
    assert bank([basis(0)], size=1).offer(basis(1)) == (False, -1)
    assert bank([]).offer(basis(1)) == (True, 0)


def test_bank_fills_up_first():
    b = bank([basis(i) for i in range(7)])
    assert b.offer(basis(7)) == (True, 7)
    for _ in range(5):
        assert b.offer(near(7, 9, 0.01)) == (False, -1)


def test_registry_outcomes():
    r = Registry()
    assert r.apply("select", -1, 5, True) == ("selected", 1)
    assert r.apply("select", -1, 5, True) == ("already_selected", 1)
    assert r.apply("select", -1, 6, True) == ("selected", 2)
    assert r.apply("correct", 1, 6, True) == ("track_occupied", 1)
    assert r.apply("correct", 1, 7, False) == ("wrong_class", 1)
    assert r.apply("correct", 1, 7, True) == ("corrected", 1)
    assert r.apply("recover", 1, 8, True) == ("not_lost", 1)
    assert r.apply("invalidate", 1, -1, True) == ("invalidated", 1)
    assert r.apply("invalidate", 1, -1, True) == ("not_active", 1)
    assert r.apply("recover", 1, 6, True) == ("track_occupied", 1)
    assert r.apply("recover", 1, 8, True) == ("recovered", 1)
    assert r.apply("remove", -1, 99, True) == ("not_selected", -1)
    assert r.apply("remove", -1, 8, True) == ("removed", 1)
    assert r.apply("recover", 1, 8, True) == ("unknown_target", 1)
    assert (r.lost, r.recovered) == (1, 1)
