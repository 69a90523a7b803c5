"""Imports every query module of this subpackage."""

from sightline.llm import (  # noqa: F401
    q_bpe,
    q_collocations,
    q_conversations,
    q_decontaminate,
    q_language,
    q_mixing,
    q_quality,
    q_secrets,
    q_simhash,
    q_substrings,
    q_topk,
    q_toxicity,
    q_urls,
)
from sightline.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
