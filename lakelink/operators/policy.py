"""Checks and choices around a submission: invariants, impossible metrics, capped choices, removals, samples, score grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import f05


def invariants(pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """One row on links (rid, s1): a target has at most one owner and every owner is known (entity_id of s1)."""
    links = pairs.select("rid", "s1").distinct()
    claims = links.groupBy("rid").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_records"), F.count_if(F.col("n") > 1).alias("n_claimed_again"))
    known = s1.select(F.col("entity_id").alias("s1")).distinct().withColumn("known", F.lit(True))
    owners = links.groupBy("s1").agg(F.count("*").alias("n")).join(known, "s1", "full")
    both = owners.agg(F.count_if("known").alias("n_s1"), F.count("n").alias("n_with"), F.count_if(F.col("known") & F.col("n").isNull()).alias("n_without"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_unknown_owner"))
    out = claims.crossJoin(both)  # one row each
    return out.withColumn("ok", (F.col("n_claimed_again") == 0) & (F.col("n_unknown_owner") == 0))


def impossible_metrics(metrics: DataFrame) -> DataFrame:
    """Rows (name, value) that no right count can give: rates outside 0 to 1, a median of candidates above their mean."""
    rate = F.col("name").contains("recall") | F.col("name").startswith("f05") | F.col("name").endswith("_rate") | F.col("name").startswith("precision")
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).over(Window.partitionBy())  # noqa: E731  (a metric a row: a handful)
    rows = metrics.withColumn("mean", of("mean_cands")).withColumn("median", of("median_cands"))
    outside = rate & ~F.col("value").between(0, 1)
    crossed = (F.col("name") == "median_cands") & (F.col("median") > F.col("mean"))
    return rows.filter(outside | crossed).select("name", "value")


def choose_matches(scored: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """(sid, tid, score, rank) of finite scores of at least `least`, the best `most` of an entity if a cap is asked for (ties: least tid)."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    rank = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("score"), "tid"))
    rows = scored.filter(finite & (F.col("score") >= least)).select("sid", "tid", "score").withColumn("rank", rank.cast("long"))
    return rows if most is None else rows.filter(F.col("rank") <= most)


def after_removal(scores: DataFrame) -> DataFrame:
    """An entity's F0.5 now, and without one of its right or of its wrong pairs (now, where nothing is predicted)."""
    now, n, g, tp = f05(F.col("tp"), F.col("n_pred"), F.col("n_gold")), F.col("n_pred"), F.col("n_gold"), F.col("tp")
    gone = lambda t: F.round(F.when(n <= 0, now).otherwise(f05(t, n - 1, g)), 6)
    return scores.select("sid", F.round(now, 6).alias("f05_now"), gone(F.greatest(tp - 1, F.lit(0))).alias("f05_without_right"), gone(tp).alias("f05_without_wrong"))


def resolution_value(scores: DataFrame, rates: tuple[float, ...] = (0.0, 0.05, 0.1, 0.2, 0.3)) -> DataFrame:
    """Macro F0.5 of perfect links with one wrong claim more an entity (where the rate is above 0), and after conflicts are resolved."""
    g = F.col("n_gold")
    one = scores.agg(F.avg(f05(g, g + F.when(g > 0, 1).otherwise(0), g)).alias("worse"), F.avg(f05(g, g, g)).alias("clean"))
    rows = one.withColumn("p_wrong", F.explode(F.array(*map(F.lit, rates))))
    before = F.when(F.col("p_wrong") > 0, F.col("worse")).otherwise(F.col("clean"))
    return rows.select("p_wrong", F.round(before, 6).alias("f05_before"), F.round("clean", 6).alias("f05_after"), F.round(F.col("clean") - before, 6).alias("delta"))


def score_grid(scored: DataFrame, n: int = 60) -> DataFrame:
    """(i, threshold): n thresholds at equal ranks of the scores, nearest rank. Scores are counted first, so the running sum
    goes over distinct scores (rounded by the callers)."""
    counts = scored.groupBy("score").agg(F.count("*").alias("c"))
    run = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = counts.select("score", (F.sum("c").over(run) - F.col("c")).alias("start"), F.sum("c").over(run).alias("stop"), F.sum("c").over(Window.partitionBy()).alias("total"))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.cast("long").alias("i"), F.floor(i * (F.col("total") - 1) / float(max(n - 1, 1)) + 0.5).alias("at")))
    rows = steps.withColumn("p", F.explode(F.filter(places, lambda p: (p["at"] >= F.col("start")) & (p["at"] < F.col("stop")))))
    return rows.select(F.col("p.i").alias("i"), F.col("score").alias("threshold"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows by the least digest of seed and key: uniform, and the same at every partitioning."""
    return rows.withColumn("__d", F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))).orderBy("__d", key).limit(n).drop("__d")


def hash_sample(rows: DataFrame, key: str, every: int, seed: str) -> DataFrame:
    """One row in `every` by digest: rows have no stable order to count along."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, 8), 16, 10).cast("long")
    return rows.filter(number % every == 0)


def without(lists: DataFrame, removed: DataFrame) -> DataFrame:
    """Match lists (source1_entity_id, matched_entity_ids) without removed pairs (sid, tid), the others in their order."""
    gone = removed.groupBy(F.col("sid").alias("source1_entity_id")).agg(F.collect_set("tid").alias("gone"))
    ids = F.filter(F.split("matched_entity_ids", ","), lambda t: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), t))
    return lists.join(gone, "source1_entity_id", "left").select("source1_entity_id", F.array_join(ids, ",").alias("matched_entity_ids"))


def stacked(*frames: DataFrame) -> DataFrame:
    """All rows of tables with different columns; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def source_context(best: DataFrame, least: float = 0.3, high: float = 0.9) -> DataFrame:
    """Of the other members of each best pair's cluster (rid, s1, p1; members from `least` on): confident ones, those of
    the record's own source (the id's prefix) and of the others."""
    by = Window.partitionBy("s1")
    inside, sure, source = F.col("p1") >= least, F.col("p1") >= high, F.substring("rid", 1, 2)
    own = inside.cast("long")
    n, same = F.count_if(inside).over(by), F.count_if(inside).over(Window.partitionBy("s1", source))
    return best.select("rid", "s1", (F.count_if(sure).over(by) - sure.cast("long")).alias("c_n_hi_oth"), (same - own).alias("c_n_same_src"), (n - same).alias("c_n_other_src"))


def competition(best: DataFrame, pairs: DataFrame, name: str, addr: str) -> DataFrame:
    """How good the candidates (rid, s1, name and addr scores of 0 to 100) are that a record's best pair passed over: greatest scores
    (-1 if there is none) and counts of high ones."""
    rows = pairs.join(best.select("rid", F.col("s1").alias("chosen")), "rid").filter("s1 <> chosen")
    a, n = F.col(addr), F.col(name)
    agg = rows.groupBy("rid").agg(F.max(a).alias("max_addr"), F.max(n).alias("max_name"), F.count_if(a >= 90).alias("n_addr"), F.count_if(n >= 90).alias("n_name"), F.count_if((a >= 90) & (n >= 70)).alias("n_both"))
    return best.select("rid").join(agg, "rid", "left").na.fill(-1.0, ["max_addr", "max_name"]).na.fill(0, ["n_addr", "n_name", "n_both"])


def band(pairs: DataFrame, difference: Column, reach: int = 30) -> DataFrame:
    """Pairs whose difference lies within the band, counted by it (an equi-join's residual filter)."""
    return pairs.select(difference.cast("long").alias("d")).filter(F.col("d").between(-reach, reach)).groupBy("d").agg(F.count("*").alias("n"))
