"""Decisions, conflicts, context of clusters and look-alikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normalize import house_number

# Offsets of house numbers that mark a look-alike.
STRONG, WEAK = (3, 4, 5, 7, 9, 11, 13, 21), (1, 2)
P1_LEAST = 0.02


def bucket(p: Column) -> Column:
    """Confidence of a probability on a closed scale; null and NaN are very_low."""
    return F.when(p.isNull() | F.isnan(p), "very_low").when(p >= 0.9, "very_high").when(p >= 0.7, "high").when(p >= 0.4, "medium").when(p >= 0.1, "low").otherwise("very_low")


def decide(p2: Column, p1: Column, threshold: Column | float, p1_least: float = P1_LEAST) -> Column:
    """MATCH, ABSTAIN (unsure or NaN) or NO_CANDIDATE (a probability is missing, or p1 too low)."""
    return F.when(p2.isNull() | p1.isNull(), "NO_CANDIDATE").when(F.isnan(p1) | F.isnan(p2), "ABSTAIN").when(p1 < p1_least, "NO_CANDIDATE").when(p2 >= threshold, "MATCH").otherwise("ABSTAIN")


def sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts of decisions at each threshold; one pass over the scores, each row meets the short list in itself."""
    rows = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    d = decide(F.col("p2"), F.col("p1"), F.col("threshold"))
    return rows.groupBy("threshold").agg(*(F.count_if(d == x).alias(f"n_{x.lower()}") for x in ("MATCH", "ABSTAIN", "NO_CANDIDATE")))


def resolve_conflicts(scored: DataFrame, least: float = 0.0) -> DataFrame:
    """At most one s1 for each rid: the best score, of equal ones the lower s1."""
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "s1")
    return scored.filter((F.col("score") >= least) & ~F.isnan("score")).withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")


def best_pairs(scored: DataFrame) -> DataFrame:
    """For each rid the best s1, its score, the runner-up's (0 if none), the margin and counts."""
    by = Window.partitionBy("rid")
    order = by.orderBy(F.desc("score"), "s1")
    rows = scored.withColumn("rn", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    rows = rows.withColumn("n_all", F.count("*").over(by)).withColumn("n_gt01", F.sum((F.col("score") > 0.1).cast("long")).over(by)).filter("rn = 1")
    return rows.select("rid", "s1", F.col("score").alias("p1"), F.col("second").alias("p1_2nd"), F.round(F.col("score") - F.col("second"), 6).alias("p1_margin"), "n_gt01", "n_all")


def context(best: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts, sum and maximum of the other members of each record's cluster (score at least `least`)."""
    by = Window.partitionBy("s1")
    inside = F.col("p1") >= least
    p = F.when(inside, F.col("p1"))
    top = by.orderBy(F.desc_nulls_last(p), "rid")
    rows = best.withColumns({"c_n": F.count(p).over(by), "c_sum": F.coalesce(F.sum(p).over(by), F.lit(0.0)), "c_rank": F.row_number().over(top), "c_max": F.max(p).over(by)})
    rows = rows.withColumn("c_second", F.max(F.when(F.col("c_rank") == 2, p)).over(by))
    own = F.when(inside, 1).otherwise(0)
    return rows.select("rid", "s1", "p1", (F.col("c_n") - own).cast("long").alias("c_n_oth"), F.round(F.col("c_sum") - F.when(inside, F.col("p1")).otherwise(0.0), 6).alias("c_sum_oth"), F.coalesce(F.when(F.col("c_rank") == 1, F.col("c_second")).otherwise(F.col("c_max")), F.lit(0.0)).alias("c_max_oth"))


def duplicates(norm: DataFrame) -> DataFrame:
    """How many records share the core name or the address within the country (0 for a missing one)."""
    count = lambda c: F.when(F.col(c).isNotNull(), F.count("*").over(Window.partitionBy("country", c))).otherwise(0).cast("long")
    return norm.select("entity_id", count("n_core_sorted").alias("name_dups"), count("a_sorted").alias("addr_dups"))


def offset_rule(pairs: DataFrame, left: str, right: str, strict: Column | None = None) -> DataFrame:
    """pairs (sid, tid, ...) with d = house number of the target less that of Source 1, shared = how many of
    the sid's pairs have this d, and removed: a lone strong offset, or under `strict` any strong or weak one."""
    rows = pairs.withColumn("d", house_number(F.col(right)) - house_number(F.col(left)))
    rows = rows.withColumn("shared", F.when(F.col("d").isNotNull(), F.count("*").over(Window.partitionBy("sid", "d"))).otherwise(0).cast("long"))
    lone = F.col("d").isin(*STRONG) & (F.col("shared") == 1)
    any_ = F.col("d").isin(*STRONG, *WEAK) if strict is None else strict & F.col("d").isin(*STRONG, *WEAK)
    return rows.withColumn("removed", F.coalesce(lone if strict is None else lone | any_, F.lit(False)))
