"""The whole linker: entities and known links in, scored matches out, stage by stage through a cache of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, features, scoring
from ..operators.normalize import normalized
from ..sources.files import StageCache, fingerprint, match_lists


def run(spark: SparkSession, entities: DataFrame, gold: DataFrame, folder: str, input_key: str, cap: int = blocking.MAX_CANDIDATES, max_df: int = blocking.MAX_TOKEN_DF) -> dict:
    """Returns the matches (one row an entity of Source 1), candidates, weights and threshold. A stage's key holds all
    configuration and keys above it, so no stale table is read."""
    cache = StageCache(folder)
    k1 = fingerprint({"stage": "norm"}, input_key)
    norm = cache.get(spark, "norm", k1, lambda: normalized(entities))
    k2 = fingerprint({"stage": "candidates", "cap": cap, "max_df": max_df}, k1)
    cand = cache.get(spark, "candidates", k2, lambda: blocking.candidates(blocking.channel_pairs(norm, max_df, cap), cap))
    k3 = fingerprint({"stage": "features"}, k2)
    feat = cache.get(spark, "features", k3, lambda: features.pair_features(cand, norm))
    weights, intercept, threshold = scoring.fit_and_tune(feat, gold, norm, features.COLUMNS)
    scored = feat.select("sid", "tid", scoring.sigmoid(scoring.linear(weights, intercept)).alias("score"))
    universe = norm.filter(F.col("entity_id").startswith("S1-"))
    return {"matches": match_lists(universe, scored.filter(F.col("score") >= threshold)), "candidates": match_lists(universe, cand, "candidate_entity_ids"), "scored": scored, "weights": weights, "intercept": intercept, "threshold": threshold}
