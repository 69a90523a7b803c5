"""Places where callers plug in their own models and rules.

Models come in as plain functions that Spark runs on Arrow batches next to the data; rules
come in as columns and are optimised like any other expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sightline.operators import matching, similarity
from sightline.policy import RecognitionPolicy


def extract_embeddings(
    crops: DataFrame, keys: list[str], crop: str, provider: Callable[[list], np.ndarray], batch: int = 32
) -> DataFrame:
    """Run ``provider(crops) -> (N, D)`` over a table of crops, ``batch`` at a time."""
    types = dict(crops.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), batch):
                part = pdf.iloc[low : low + batch]
                values = np.asarray(provider(part[crop].tolist()), dtype=np.float32)
                if values.ndim != 2 or len(values) != len(part):
                    raise ValueError("the provider must return one row per crop")
                yield part[keys].assign(embedding=list(values))

    return crops.select(*keys, crop).mapInPandas(run, schema)


def read_plates(
    crops: DataFrame, keys: list[str], crop: str, provider: Callable[[object], Sequence[tuple]]
) -> DataFrame:
    """Run ``provider(crop) -> [(plate, conf, x1, y1, x2, y2), ...]``.

    A crop whose reading fails becomes one row with ``error`` set; the others go on.
    """
    types = dict(crops.dtypes)
    fields = ["obs_idx", "plate", "conf", "x1", "y1", "x2", "y2", "error"]
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema += ", obs_idx int, plate string, conf double, x1 int, y1 int, x2 int, y2 int, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, image in zip(pdf[keys].itertuples(index=False), pdf[crop]):
                try:
                    found = [(i, *reading, None) for i, reading in enumerate(provider(image))]
                except Exception as exc:  # noqa: BLE001 - isolates one crop from the rest
                    found = [(0, None, None, None, None, None, None, f"{type(exc).__name__}: {exc}")]
                rows += [(*key, *f) for f in found]
            out = pd.DataFrame(rows, columns=[*keys, *fields])
            for name in ("obs_idx", "x1", "y1", "x2", "y2"):
                out[name] = out[name].astype("Int32")
            yield out

    return crops.select(*keys, crop).mapInPandas(run, schema)


def recognize(
    candidates: DataFrame,
    identities: DataFrame,
    policy: RecognitionPolicy,
    keys: list[str],
    enabled: Column | None = None,
    pair_condition: Column | None = None,
) -> DataFrame:
    """Match candidates with identities under a caller's filters.

    ``enabled`` replaces the opt-in flag; ``pair_condition`` sees the columns of both
    sides (candidates as ``c``, identities as ``i``) and removes pairs before ranking.
    """
    usable = identities.where(F.col("recognition_enabled") if enabled is None else enabled)
    targets = usable.select("domain", F.col("identity_id").alias("target_id"), "centroid")
    floor = policy.threshold - policy.margin
    ids = tuple(dict.fromkeys([k for k in keys if k != "domain"] + ["track_id"]))
    pairs = similarity.scored_pairs(candidates, targets, ["domain"], floor, every=True, ids=ids)
    if pair_condition is not None:
        on = ["domain", *ids]
        left = candidates.drop("embedding").alias("c")
        right = usable.drop("centroid").alias("i")
        cond = [F.col(f"p.{c}") == F.col(f"c.{c}") for c in on]
        joined = pairs.alias("p").join(left, cond)
        same = (F.col("p.domain") == F.col("i.domain")) & (F.col("p.target_id") == F.col("i.identity_id"))
        pairs = joined.join(right, same).where(pair_condition).select("p.*")
    return matching.margin_match(pairs, keys, policy.threshold, policy.margin)
