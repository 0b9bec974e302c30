"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of BLOCK words each. Slot i maps the point frac(i * golden ratio)
through the cumulative target weights to a source, so every stretch of the mix holds the sources
near their weights. Slots are ranked within their source; rank k takes block k of the source's
line: its documents in shuffled (hashed) order, laid end to end and cut into blocks of BLOCK
words, the line laid down twice, as a target may reach twice its source's size.

A hot source is one key in no step: a document's place in its source's line is a prefix sum over
(source, bucket) sums, with buckets by hash whose number follows the rows.

Defined results: null sources are one source, the last; null texts have size 0 and take nothing;
sources of size 0 have target 0. Repeated rows are documents of their own. Empty tables give no
rows. Targets: 'water filling', min(2 * size, level * weight), so that they sum to 150 % of all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2
BLOCK = 64
#: Mean number of documents in a bucket of the shuffled order.
PER_BUCKET = 2048
GOLDEN = 0.6180339887498949
SEED = 20


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, size) per document -> (source, source_size, weight, target, rank), a row per source.

    The level of the water filling comes from one pass over sources in order of MOST * size / weight:
    with the first j sources full, the rest share what is left by weight."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.expr("CAST(source AS BINARY)").asc_nulls_last())  # UTF-8 sorts as code points do
    # One row per source from here on.
    ranked = per.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", F.when(F.col("source_size") > 0, weight).otherwise(F.lit(0.0)))
    full = F.lit(float(MOST)) * F.col("source_size")
    by_ratio = Window.orderBy(F.when(F.col("weight") > 0, F.try_divide(full, F.col("weight"))).otherwise(F.lit(0.0)), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("__full", full)
        .withColumn("__total", F.sum("source_size").over(whole) * SHARE)
        .withColumn("__weights", F.sum("weight").over(whole))
        .withColumn("__full_before", F.coalesce(F.sum("__full").over(before), F.lit(0.0)))
        .withColumn("__weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    level = (F.col("__total") - F.col("__full_before")) / F.nullif(F.col("__weights") - F.col("__weight_before"), F.lit(0.0))
    # The first source that its share at this level doesn't fill fixes the level for it and all later ones.
    opens = F.when((F.col("weight") > 0) & (level * F.col("weight") <= F.col("__full")), F.struct(F.try_divide("__full", "weight").alias("at"), "rank", level.alias("level")))
    filled = filled.withColumn("__level", F.min(opens).over(whole)["level"])
    target = F.least(F.col("__full"), F.coalesce(F.col("__level") * F.col("weight"), F.col("__full")))
    return filled.select("source", "source_size", "weight", F.when(F.col("weight") > 0, target).otherwise(F.lit(0.0)).alias("target"), F.col("rank").cast("int").alias("rank"))


def schedule(targets: DataFrame, n_slots: int, cells: int) -> DataFrame:
    """(slot, rank, place): the slot's source and the slot's place among those of its source."""
    spark = targets.sparkSession
    upto = Window.orderBy("rank")
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marks = targets.filter("target > 0").select("rank", (F.sum("target").over(upto) / F.sum("target").over(total)).alias("high")).withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))
    marks = marks.withColumn("high", F.when(F.lead("rank").over(upto).isNull(), F.lit(1.0)).otherwise(F.col("high")))
    # Points meet their source by an equi-join on cells of the unit interval, a few sources to a cell.
    cell_of = lambda c: F.floor(c * cells).cast("long")
    marks = marks.withColumn("__cell", F.explode(F.sequence(cell_of(F.col("low")), F.least(cell_of(F.col("high")), F.lit(cells - 1)))))
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("__point", F.expr(f"slot * {GOLDEN}D - floor(slot * {GOLDEN}D)"))
    slots = slots.withColumn("__cell", F.least(cell_of(F.col("__point")), F.lit(cells - 1))).join(marks, "__cell").filter("__point >= low AND (__point < high OR high >= 1)")
    parts = max(1, min(4096, n_slots // 200_000 + 1))
    slots = slots.withColumn("__part", (F.col("slot") * parts / n_slots).cast("int"))
    # Places: slots before this stretch of the row, plus the place within it.
    counts = slots.groupBy("rank", "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("rank").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    own = Window.partitionBy("rank", "__part").orderBy("slot")
    return slots.join(counts, ["rank", "__part"]).select("slot", "rank", (F.col("__before") + F.row_number().over(own) - 1).alias("place"))


def _key(id_column: str | None) -> Column:
    return F.xxhash64(F.lit(SEED), F.col(id_column)) if id_column else F.xxhash64(F.lit(SEED), F.lit(0))


def mixed(df: DataFrame, source: str = "source", size: str = "size", id_column: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """df (with a size column) -> the same rows with source_size, target, and taken_first and taken_second:
    the words that the mix takes of the document on its source's first and second round."""
    spark = df.sparkSession
    rows = df.withColumn("__source", F.col(source)).withColumn("__size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    targets = source_targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")))
    targets = common.written(targets.coalesce(1), "mix-targets")
    n_sources, goal = targets.agg(F.count("*"), F.sum("target")).collect()[0]
    goal = goal or 0.0
    n_slots = round(goal / block)
    n_docs = rows.count()
    buckets = max(1, n_docs // PER_BUCKET)
    rows = rows.withColumn("__hash", _key(id_column)).withColumn("__bucket", F.pmod("__hash", F.lit(buckets)).cast("int"))
    # Sources as small numbers, so that null sources join too.
    names = targets.select(F.col("source").alias("__name"), F.col("rank").alias("__rank"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    rows = rows.join(names, F.col("__source").eqNullSafe(F.col("__name")), "left").drop("__name")
    sums = rows.groupBy("__rank", "__bucket").agg(F.sum("__size").alias("__sum"))
    earlier = Window.partitionBy("__rank").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__rank", "__bucket", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__rank", "__bucket").orderBy("__hash", id_column, "__size")
    rows = rows.join(sums, ["__rank", "__bucket"]).withColumn("__n", F.row_number().over(own)).withColumn("__from", F.col("__before") + F.sum("__size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    # The pieces of each document in the blocks of both rounds, joined with the slots that take a block.
    plan = schedule(targets, n_slots, 64 + 4 * n_sources)
    b = F.lit(block).cast("long")
    pieces = (
        rows.filter("__size > 0")
        .select("__rank", "__bucket", "__n", "__size", F.explode(F.array(F.lit(0), F.lit(1))).alias("__round"), "__from", "__source_size")
        .withColumn("__start", F.col("__from") + F.col("__round") * F.col("__source_size"))
        .withColumn("__end", F.col("__start") + F.col("__size"))
        .withColumn("__block", F.explode(F.sequence(F.floor(F.col("__start") / b), F.floor((F.col("__end") - 1) / b))))
    )
    taken = pieces.join(plan.select(F.col("rank").alias("__rank"), F.col("place").alias("__block")), ["__rank", "__block"])
    words = F.least(F.col("__end"), (F.col("__block") + 1) * b) - F.greatest(F.col("__start"), F.col("__block") * b)
    taken = taken.groupBy("__rank", "__bucket", "__n").agg(*(F.sum(F.when(F.col("__round") == r, words)).cast("long").alias(n) for r, n in ((0, "__first"), (1, "__second"))))
    out = rows.join(taken, ["__rank", "__bucket", "__n"], "left")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.coalesce("__first", F.lit(0)).cast("long").alias("taken_first"), F.coalesce("__second", F.lit(0)).cast("long").alias("taken_second"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", common.n_words().alias("size"))
    docs = common.written(docs, "mix-sizes")  # sizes are read four times; the texts once
    out = mixed(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("taken_first") + F.col("taken_second")).alias("taken"))
