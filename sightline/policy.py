"""Matching, gating and retention parameters, one frozen record per domain.

The numbers are fixed values: the defaults that callers of the system expect.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

PERSON_CLASSES = (0,)
VEHICLE_CLASSES = (2, 5, 7)
DOMAIN_CLASSES = {"person": PERSON_CLASSES, "vehicle": VEHICLE_CLASSES}


@dataclass(frozen=True)
class QualityPolicy:
    domain: str = "person"
    min_confidence: float = 0.35
    max_edge_truncation: float = 0.30
    max_overlap: float = 0.40
    edge_margin: float = 0.01
    min_crop_width: int = 40
    min_crop_height: int = 100

    @property
    def classes(self) -> tuple[int, ...]:
        return DOMAIN_CLASSES[self.domain]


@dataclass(frozen=True)
class RecoveryPolicy:
    lost_grace_frames: int = 5
    reference_interval: int = 15
    interval: int = 5
    threshold: float = 0.85
    margin: float = 0.05
    support_threshold: float = 0.80
    support_top_k: int = 3
    reference_update_threshold: float = 0.80
    bank_size: int = 8
    min_age: int = 3
    hits: int = 2
    pending_max_age: int = 60
    budget: int = 3


@dataclass(frozen=True)
class RecognitionPolicy:
    interval: int = 10
    min_age: int = 5
    threshold: float = 0.80
    margin: float = 0.05
    hits: int = 2
    budget: int = 3
    retry_interval: int = 15


@dataclass(frozen=True)
class GuardPolicy:
    history: int = 5
    max_width_growth: float = 1.45
    max_area_growth: float = 1.70
    max_center_shift: float = 0.35
    overlap_trigger: float = 0.15
    overlap_clear: float = 0.10
    hits: int = 2
    max_candidates: int = 3
    # True reproduces the historical behaviour in which overlap alone is enough.
    overlap_alone: bool = False


@dataclass(frozen=True)
class EnrichmentPolicy:
    stable_frames: int = 30
    bank_size: int = 8
    duplicate_threshold: float = 0.95


@dataclass(frozen=True)
class PlatePolicy:
    min_confidence: float = 0.85
    min_width: int = 60
    min_height: int = 18
    min_sharpness: float = 80.0
    hits: int = 2
    pending_max_age: int = 30
    min_age: int = 3
    interval_frames: int = 5
    interval_ms: int = 500
    max_result_age: int = 15


@dataclass(frozen=True)
class DumpPolicy:
    match_iou: float = 0.30
    divergence_iou: float = 0.80
    divergence_area: float = 1.30
    divergence_center: float = 0.25


PERSON_QUALITY = QualityPolicy()
VEHICLE_QUALITY = QualityPolicy(
    domain="vehicle", max_overlap=0.60, min_crop_width=40, min_crop_height=40
)
PERSON_RECOVERY = RecoveryPolicy()
VEHICLE_RECOVERY = RecoveryPolicy(
    threshold=0.60,
    margin=0.08,
    support_threshold=0.55,
    reference_update_threshold=0.55,
    budget=1,
)
PERSON_RECOGNITION = RecognitionPolicy()
VEHICLE_RECOGNITION = RecognitionPolicy(
    interval=5, min_age=3, threshold=0.60, margin=0.08, budget=1
)
GUARD = GuardPolicy()
ENRICHMENT = EnrichmentPolicy()
PLATE = PlatePolicy()
DUMP = DumpPolicy()

ROI_MIN_IOU = 0.20
LOST_RETENTION_SECONDS = 600.0
MAX_LOG_EVENTS = 1000
MAX_FEED_EVENTS = 100
UNIQUE_TRACK_WINDOW = 4096
FPS_WINDOW = 30

# The slower edge devices run with these differences.
EDGE_RECOVERY = {
    "person": replace(PERSON_RECOVERY, interval=2, min_age=2),
    "vehicle": replace(VEHICLE_RECOVERY, interval=2, min_age=2),
}
EDGE_GUARD = replace(GUARD, overlap_clear=0.15)
