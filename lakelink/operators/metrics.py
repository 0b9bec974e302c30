"""F0.5 by entity, sweeps, recall of blocking and validation of results (M1-M7, V1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(tp: Column, n_pred: Column, n_gold: Column) -> Column:
    """5 TP / (5 TP + 4 FP + FN); 1 if both sides are empty, 0 if one is."""
    fp, fn = n_pred - tp, n_gold - tp
    return F.when((n_pred == 0) & (n_gold == 0), 1.0).when((n_pred == 0) | (n_gold == 0), 0.0).otherwise(5.0 * tp / (5.0 * tp + 4.0 * fp + fn))


def entity_scores(universe: DataFrame, pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(sid, tp, n_pred, n_gold, f05) for every entity of the universe."""
    both = pred.select("sid", "tid").distinct().withColumn("p", F.lit(1)).join(gold.select("sid", "tid").distinct().withColumn("g", F.lit(1)), ["sid", "tid"], "full")
    counts = both.groupBy("sid").agg(F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"), F.count("p").alias("n_pred"), F.count("g").alias("n_gold"))
    rows = universe.select(F.col("entity_id").alias("sid"), "country").join(counts, "sid", "left").na.fill(0, ["tp", "n_pred", "n_gold"])
    return rows.withColumn("f05", F.round(f05(F.col("tp"), F.col("n_pred"), F.col("n_gold")), 6))


def macro(scores: DataFrame, by: str | None = None) -> DataFrame:
    rows = scores.groupBy(by) if by else scores.groupBy()
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("f05"), 6).alias("macro_f05"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"))


def threshold_sweep(universe: DataFrame, scored: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, macro_f05, tp, n_pred): the universe's entities without any pair are counted, not listed at each threshold."""
    hit = gold.select("sid", "tid").distinct().withColumn("g", F.lit(1))
    rows = scored.select("sid", "tid", "score").join(hit, ["sid", "tid"], "left").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    per = rows.groupBy("threshold", "sid").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("n_pred"), F.count_if((F.col("score") >= F.col("threshold")) & F.col("g").isNotNull()).alias("tp"))
    n_gold = hit.groupBy("sid").agg(F.count("*").alias("n_gold"))
    per = per.join(n_gold, "sid", "left").na.fill(0, ["n_gold"]).withColumn("f", f05(F.col("tp"), F.col("n_pred"), F.col("n_gold")))
    total = universe.join(n_gold, F.col("entity_id") == F.col("sid"), "left").join(scored.select(F.col("sid").alias("seen")).distinct(), F.col("entity_id") == F.col("seen"), "left")
    rest = total.agg(F.count("*").alias("n"), F.count_if(F.col("seen").isNull() & F.col("n_gold").isNull()).alias("empty"))
    sums = per.groupBy("threshold").agg(F.sum("f").alias("f"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"))
    return sums.crossJoin(F.broadcast(rest)).select("threshold", F.round((F.col("f") + F.col("empty")) / F.col("n"), 6).alias("macro_f05"), "tp", "n_pred")  # rest is one row


def blocking_recall(cand: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of the gold links that candidates hold, by the target's source."""
    rows = gold.select("sid", "tid").distinct().join(cand.select("sid", "tid").distinct().withColumn("hit", F.lit(1)), ["sid", "tid"], "left")
    return rows.groupBy(F.substring("tid", 1, 2).alias("source")).agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def violations(universe: DataFrame, targets: DataFrame, matches: DataFrame, cand: DataFrame) -> DataFrame:
    """(problem, n) of a result: rows (source1_entity_id, matched_entity_ids) and candidate lists of the same form."""
    from ..sources.files import edges

    ids = matches.select("source1_entity_id")
    e = edges(matches)
    c = edges(cand.withColumnRenamed("candidate_entity_ids", "matched_entity_ids"))
    known = universe.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    checks = {
        "duplicate rows": ids.groupBy("source1_entity_id").count().filter("count > 1"),
        "missing entities": known.join(ids, "source1_entity_id", "left_anti"),
        "unknown entities": ids.distinct().join(known, "source1_entity_id", "left_anti"),
        "duplicate matches": e.groupBy("sid", "tid").count().filter("count > 1"),
        "bad prefix": e.filter(~(F.col("tid").startswith("S2-") | F.col("tid").startswith("S3-"))),
        "absent targets": e.select("tid").distinct().join(targets.select(F.col("entity_id").alias("tid")), "tid", "left_anti"),
        "matches beyond candidates": e.select("sid", "tid").subtract(c.select("sid", "tid")),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionAll(one)
    return out
