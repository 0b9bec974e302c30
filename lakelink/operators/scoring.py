"""Balanced logistic scorer: fitted by Spark, folded into raw weights, applied as one column."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import threshold_sweep
from .normalize import sample_bucket


def linear(weights: dict[str, float], intercept: float) -> Column:
    """intercept + sum of weight * feature, nulls as 0."""
    out = F.lit(float(intercept))
    for c, w in weights.items():
        out = out + F.lit(float(w)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def fit_logistic(rows: DataFrame, features: list[str], label: str = "label") -> tuple[dict[str, float], float]:
    """Weights on the raw features and the intercept; both classes weigh the same."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    n = sum(counts.values())
    if set(counts) != {0, 1}:
        return dict.fromkeys(features, 0.0), 0.0 if not n else math.copysign(10.0, 2 * counts.get(1, 0) - n)
    rows = rows.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features), F.col(label).cast("double").alias("label"))
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0])))
    rows = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="x").fit(rows)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1.0 / n, standardization=False).fit(scaler.transform(rows))
    mean, std, coef = scaler.mean.toArray(), scaler.std.toArray(), model.coefficients.toArray()
    raw = [c / s if s > 0 else 0.0 for c, s in zip(coef, std, strict=True)]
    return dict(zip(features, map(float, raw), strict=True)), float(model.intercept - sum(w * m for w, m in zip(raw, mean, strict=True)))


def fit_and_tune(feat: DataFrame, gold: DataFrame, universe: DataFrame, features: list[str], grid: list[float] | None = None) -> tuple[dict, float, float]:
    """Fit on the entities with an even hash, tune the threshold on those with an odd one (over all of them, with all their
    gold links); returns weights, intercept and threshold."""
    labelled = feat.join(gold.select("sid", "tid").distinct().withColumn("g", F.lit(1)), ["sid", "tid"], "left").withColumn("label", F.coalesce("g", F.lit(0)))
    half = sample_bucket(F.col("sid"), 2)
    weights, intercept = fit_logistic(labelled.filter(half == 0), features)
    tune = universe.filter((sample_bucket(F.col("entity_id"), 2) == 1) & F.col("entity_id").startswith("S1-"))
    scored = feat.filter(half == 1).select("sid", "tid", sigmoid(linear(weights, intercept)).alias("score"))
    grid = grid or [i / 20 for i in range(1, 20)]
    own = gold.filter(half == 1)
    best = threshold_sweep(tune, scored, own, grid).orderBy(F.desc("macro_f05"), "threshold").first()
    return weights, intercept, best["threshold"] if best else 0.5
