"""Maximal marginal relevance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.operators.ranking import dedupe_previews, top_hits


@dataclass(frozen=True)
class Diversity:
    relevance: float = 0.7
    min_distance: float = 0.3
    max_candidates: int = 50


LEVELS = {"high": Diversity(0.6, 0.4), "medium": Diversity(0.7, 0.3), "low": Diversity(0.85, 0.15)}


def mmr_order(scores: np.ndarray, vectors: np.ndarray, config: Diversity) -> list[int]:
    """Positions in the order of greedy selection: relevance against similarity to what is chosen already.

    Candidates closer than min_distance to a chosen one wait; when all that are left wait, the most relevant is taken.
    Ties go to the earlier candidate. The result is a permutation.
    """
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1.0, norms)
    similar = unit @ unit.T
    n = len(scores)
    left = np.ones(n, dtype=bool)
    nearest = np.zeros(n)
    order: list[int] = []
    for _ in range(n):
        value = config.relevance * scores - (1 - config.relevance) * nearest
        allowed = left & ((1 - nearest >= config.min_distance) if order else True)
        pick = int(np.argmax(np.where(allowed, value, -np.inf))) if allowed.any() else int(np.argmax(np.where(left, scores, -np.inf)))
        nearest = similar[:, pick].copy() if not order else np.maximum(nearest, similar[:, pick])
        order.append(pick)
        left[pick] = False
    return order


def mmr_rerank(hits: DataFrame, config: Diversity = Diversity(), vector: str = "vector", by: str = "query_id", ready: bool = False) -> DataFrame:
    """The best max_candidates hits of every query in MMR order, as column ``mmr_rank`` (1 first).

    Hits carry a vector column. A query's candidates are bounded by max_candidates, so a group always fits a task.
    Null vectors count as zero vectors; duplicates by preview go first. Hits that are ``ready`` have been through both
    steps and carry their rank.
    """
    candidates = hits if ready else top_hits(dedupe_previews(hits, by), config.max_candidates, by)
    schema = ", ".join(f"`{n}` {t}" for n, t in candidates.dtypes) + ", mmr_rank int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        size = max((len(v) for v in rows[vector] if v is not None), default=1)
        vectors = np.stack([np.asarray(v, dtype=float) if v is not None and len(v) == size else np.zeros(size) for v in rows[vector]])
        order = mmr_order(rows["score"].to_numpy(dtype=float), vectors, config)
        out = rows.iloc[order].copy()
        out["mmr_rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out

    return candidates.groupBy(by).applyInPandas(run, schema)
