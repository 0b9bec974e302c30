"""Removal of look-alikes where the expected score gains from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decisions import STRONG


def _f05(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn == 0, 1.0).otherwise(5 * tp / (5 * tp + 4 * fp + fn))


def expected_gain(r: Column, q: Column, m: Column) -> Column:
    """Expected change of an entity's F0.5 when r of its m links go, each of them wrong with probability q."""
    r, m, q = r.cast("double"), m.cast("double"), q.cast("double")

    def term(j: Column) -> Column:
        choose = F.aggregate(F.sequence(F.lit(0), j.cast("int")), F.lit(1.0), lambda acc, i: F.when(i == 0, acc).otherwise(acc * (r - j + i) / i))
        return choose * F.pow(q, j) * F.pow(1 - q, r - j) * (_f05(m - r, F.lit(0.0), r - j) - _f05(m - j, j, F.lit(0.0)))

    return F.aggregate(F.sequence(F.lit(0), r.cast("int")), F.lit(0.0), lambda acc, j: acc + term(j.cast("double")))


def gated(flagged: DataFrame) -> DataFrame:
    """Flagged links (s1, rid, q, m: the links of the entity) whose joint removal gains: all of an entity or none."""
    per = flagged.groupBy("s1").agg(F.count("*").alias("r"), F.avg("q").alias("mean_q"), F.max("m").alias("m"))
    worth = per.filter(expected_gain(F.col("r"), F.col("mean_q"), F.col("m")) > 0).select("s1")
    return flagged.join(worth, "s1", "left_semi").select("s1", "rid")


def offset_classes(links: DataFrame, classes: list[tuple]) -> DataFrame:
    """links: s1, rid, country, d (house offset), same_name. classes: (country, offsets, same_name, confirmed, shared, q);
    the first that fits a link gives its probability of being wrong. Returns the links to remove."""
    m, conf = (links.groupBy("s1").agg(F.count("*").alias("m"), (F.count_if(F.col("d") == 0) > 0).alias("confirmed")), links.filter("d IS NOT NULL").groupBy("s1", "d").agg((F.count("*") >= 2).alias("shared")))
    rows = links.join(m, "s1").join(conf, ["s1", "d"], "left")
    q = F.lit(None).cast("double")
    for country, offsets, same, confirmed, shared, p in reversed(classes):
        fits = (F.col("country") == country) & F.col("d").isin(*offsets) & (F.col("same_name") == same) & (F.col("confirmed") == confirmed) & (F.coalesce("shared", F.lit(False)) == shared)
        q = F.when(fits, p).otherwise(q)
    return gated(rows.withColumn("q", q).filter("q IS NOT NULL").select("s1", "rid", "q", "m"))


def symmetry(cells: DataFrame, by: list[str]) -> DataFrame:
    """Share of wrong links in a cell: true noise is as often +d as -d, look-alikes have +d only."""
    pos, neg = F.count_if(F.col("d").isin(*STRONG)), F.count_if((-F.col("d")).isin(*STRONG))
    return cells.groupBy(*by).agg(pos.alias("n_plus"), neg.alias("n_minus"), F.round((pos - neg) / F.greatest(pos, F.lit(1)), 6).alias("q"))


def hidden_offsets(links: DataFrame, least: float = 0.5) -> DataFrame:
    """links: s1, rid, country, same_name, address, s1_address. Links of changed names whose addresses differ in one
    number by a strong offset, in cells (country, number shared by several links) where symmetry says look-alikes."""
    numbers = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda n: F.regexp_replace(n, "^0+(?=[0-9])", "").try_cast("bigint")))
    size = links.groupBy("s1").agg(F.count("*").alias("m"))
    rows = links.filter("NOT same_name").select("s1", "rid", "country", numbers("address").alias("a"), numbers("s1_address").alias("b")).filter("size(a) > 0 AND size(b) > 0")
    rows = rows.select("s1", "rid", "country", F.array_except("a", "b").alias("x"), F.array_except("b", "a").alias("y")).filter("size(x) = 1 AND size(y) = 1")
    rows = rows.select("s1", "rid", "country", F.get("x", F.lit(0)).alias("new"), (F.get("x", F.lit(0)) - F.get("y", F.lit(0))).alias("d"))
    often = rows.groupBy("s1", "new").agg((F.count("*") >= 2).alias("shared"))
    rows = rows.join(often, ["s1", "new"])
    good = symmetry(rows, ["country", "shared"]).filter(F.col("q") >= least).select("country", "shared", "q")
    return gated(rows.filter(F.col("d").isin(*STRONG)).join(good, ["country", "shared"]).join(size, "s1").select("s1", "rid", "q", "m"))
