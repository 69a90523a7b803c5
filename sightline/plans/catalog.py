"""Imports every query module so that the registry is complete."""

from sightline.plans import (  # noqa: F401
    q_geometry,
    q_matching,
    q_plates,
    q_sequences,
    q_sessions,
    q_sources,
    q_store,
    q_vectors,
)
from sightline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
