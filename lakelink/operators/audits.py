"""Audits of links, keys and records (M5, M7, V4-V6, R6, R9-R11, B19, B20, B11 in part)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normalize import house_number


def _rate(top: Column, bottom: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0)), 6)


def micro_scores(scored: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and F0.5 of all pairs at the threshold (one row; 0 where undefined)."""
    known = gold.select("sid", "tid").distinct().withColumn("g", F.lit(True))
    both = scored.select("sid", "tid", "score").join(known, ["sid", "tid"], "full")
    p = F.coalesce(F.col("score") >= threshold, F.lit(False))
    c = both.agg(F.count_if(p & F.col("g").isNotNull()).alias("tp"), F.count_if(p).alias("n_pred"), F.count_if("g").alias("n_gold"))
    tp, n, g = F.col("tp"), F.col("n_pred"), F.col("n_gold")
    return c.select("tp", "n_pred", "n_gold", _rate(tp, n).alias("precision"), _rate(tp, g).alias("recall"), _rate(2 * tp, n + g).alias("f1"), _rate(5 * tp, 4 * n + g).alias("f05"))


def average_precision(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """Sum over distinct scores of precision times the step of recall. Pairs are counted by score first, so the running
    sums go over distinct scores (scores are rounded to a bounded number of places by the callers)."""
    known = gold.select("sid", "tid").distinct().withColumn("g", F.lit(True))
    steps = scored.join(known, ["sid", "tid"], "left").groupBy("score").agg(F.count("*").alias("n"), F.count_if("g").alias("t"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.select("t", (F.sum("t").over(w) / F.sum("n").over(w)).alias("precision"))
    total = known.agg(F.count("*").alias("n_gold"))
    return run.agg(F.sum(F.col("t") * F.col("precision")).alias("s")).join(total).select("n_gold", F.round(F.coalesce(F.try_divide("s", "n_gold"), F.lit(0.0)), 6).alias("ap"))


def retrieval_stats(universe: DataFrame, cand: DataFrame) -> DataFrame:
    """Candidates an entity, entities without any included."""
    per = cand.groupBy("sid").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    full = universe.select(F.col("entity_id").alias("sid")).join(per, "sid", "left").select(n.alias("n"))
    return full.agg(F.count("*").alias("n_entities"), F.count_if(F.col("n") == 0).alias("n_without"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", 0.5), 6).alias("median"), F.round(F.percentile("n", 0.95), 6).alias("p95"), F.max("n").alias("most"))


def id_diagnostics(entities: DataFrame) -> DataFrame:
    """Per source (the id's prefix): rows, distinct ids, blank ids, rows beyond the first of an id, blank fields."""
    blank = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")
    return entities.groupBy(F.substring("entity_id", 1, 2).alias("source")).agg(
        F.count("*").alias("n"), F.count_distinct("entity_id").alias("n_ids"), (F.count("entity_id") - F.count_distinct("entity_id")).alias("n_repeated"),
        blank("business_name").alias("blank_names"), blank("business_address").alias("blank_addresses"), blank("country").alias("blank_countries"))


def _linked(links: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    for i in ("sid", "tid"):
        links = links.join(rows.select(F.col("entity_id").alias(i), *(F.col(c).alias(f"{i}_{c}") for c in columns)), i)
    return links


def prefix_agreement(gold: DataFrame, norm: DataFrame, lengths: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 10)) -> DataFrame:
    """By the two countries: links, and of those with both names the share that agree in the first k characters."""
    rows = _linked(gold.select("sid", "tid").distinct(), norm, ["n_name", "country"])
    same = lambda k: F.round(F.avg((F.left("sid_n_name", F.lit(k)) == F.left("tid_n_name", F.lit(k))).cast("double")), 6).alias(f"p{k}")
    return rows.groupBy(F.col("sid_country").alias("country"), F.col("tid_country").alias("target_country")).agg(F.count("*").alias("n"), *map(same, lengths))


def exact_name_audit(norm: DataFrame, gold: DataFrame) -> DataFrame:
    """By country: pairs that equal names make (products of group sizes, never listed), and links among them."""
    side = F.col("entity_id").startswith("S1-")
    groups = norm.filter("n_name IS NOT NULL").groupBy("country", "n_name").agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    volume = groups.groupBy("country").agg(F.sum(F.col("a") * F.col("b")).alias("n_pairs"), F.max(F.col("a") * F.col("b")).alias("largest"))
    found = _linked(gold.select("sid", "tid").distinct(), norm, ["n_name", "country"]).filter("sid_country = tid_country AND sid_n_name = tid_n_name")
    return volume.join(found.groupBy(F.col("sid_country").alias("country")).agg(F.count("*").alias("n_found")), "country", "left").select("country", "n_pairs", "largest", F.coalesce("n_found", F.lit(0)).alias("n_found"))


def similarity_profile(scored: DataFrame, gold: DataFrame, norm: DataFrame) -> DataFrame:
    """Score of the known links by country: mean and 10th, 50th and 90th percentile."""
    rows = scored.join(gold.select("sid", "tid").distinct(), ["sid", "tid"]).join(norm.select(F.col("entity_id").alias("sid"), "country"), "sid")
    return rows.groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), *(F.round(F.percentile("score", q / 100), 6).alias(f"p{q}") for q in (10, 50, 90)))


def address_shapes(entities: DataFrame) -> DataFrame:
    """Addresses with every run of digits as #: rows, distinct texts and distinct house numbers of a shape."""
    shape = F.regexp_replace(F.coalesce("business_address", F.lit("")), "[0-9]+", "#")
    return entities.groupBy("country", shape.alias("shape")).agg(F.count("*").alias("n"), F.count_distinct("business_address").alias("n_texts"), F.count_distinct(house_number(F.col("business_address"))).alias("n_numbers"))


def token_rewrites(words: DataFrame, before: str, after: str) -> DataFrame:
    """Rewritten words of a column of pairs: how often, and how many words end as the same one."""
    counts = words.groupBy(F.col(before).alias("word"), F.col(after).alias("rewritten")).agg(F.count("*").alias("n"))
    return counts.withColumn("n_merged", F.count("*").over(Window.partitionBy("rewritten"))).filter("word <> rewritten")


def placeholder_audit(entities: DataFrame, column: str, words: tuple[str, ...]) -> DataFrame:
    """By country: rows whose whole text, or one of whose components between commas, is a placeholder, and of the latter those with something else too."""
    parts = F.transform(F.split(F.lower(F.coalesce(column, F.lit(""))), ","), lambda p: F.trim(p))
    rows = entities.select("country", parts.alias("parts"))
    hollow, any_, rest = F.forall("parts", lambda p: p.isin("", *words)), F.exists("parts", lambda p: p.isin(*words)), F.exists("parts", lambda p: ~p.isin("", *words))
    return rows.groupBy("country").agg(F.count("*").alias("n"), F.count_if(hollow).alias("n_hollow"), F.count_if(any_).alias("n_component"), F.count_if(any_ & rest).alias("n_usable"))


def audit_keys(norm: DataFrame) -> DataFrame:
    """One row for each key of an entity: whole, sorted and prefixed names, the longest word, place keys. Columns entity_id, family, key."""
    longest = F.get(F.array_sort(F.transform("name_tokens", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    number, last = F.regexp_extract(F.coalesce("n_addr", F.lit("")), "^([0-9]+)", 1), F.element_at(F.split(F.coalesce("n_addr", F.lit("")), " "), -1)
    families = {"name_exact": F.col("n_name"), "toksort": F.col("n_sorted"), "prefix6": F.left("n_name", F.lit(6)), "char3": F.left("n_name", F.lit(3)), "rare_tok": longest, "place": last, "housenum_place": F.when(number != "", F.concat_ws("|", number, last))}
    keys = F.array(*(F.struct(F.lit(f).alias("family"), k.alias("key")) for f, k in families.items()))
    return norm.select("entity_id", F.explode(keys).alias("k")).select("entity_id", "k.family", "k.key").filter("key IS NOT NULL AND key <> ''")


def posting_sample(keys: DataFrame, cap: int) -> DataFrame:
    """Of each key the `cap` entities of least digest: a sampling operator that reruns agree on."""
    order = Window.partitionBy("family", "key").orderBy(F.md5(F.concat_ws(":", "family", "entity_id", "key")), "entity_id")
    return keys.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= cap).drop("rn")


def two_quotas(pairs: DataFrame, first: str, second: str, k: int, extra: int) -> DataFrame:
    """The best k of an entity by one score, and of the others the best `extra` by another (ties: least id)."""
    w = Window.partitionBy("sid")
    a = pairs.withColumn("r1", F.row_number().over(w.orderBy(F.desc(first), "tid")).cast("long"))
    b = a.withColumn("r2", F.row_number().over(Window.partitionBy("sid", F.col("r1") <= k).orderBy(F.desc(second), "tid")))
    return b.filter((F.col("r1") <= k) | (F.col("r2") <= extra)).select("sid", "tid", F.col("r1").alias("rank"), (F.col("r1") <= k).alias("by_first"))
