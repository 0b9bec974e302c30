"""Queries of the checks and choices around a submission, with their SQL. Importing it registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _P, _PRED, _SCORES, BEST_SQL, JACCARD_SQL, WD, W, _cand, _gold, _jaccard, _norm, _probabilities, _reverse, _scores, query
from .operators import blocking, decisions, policy
from .sources import adapters, files


@query(f"""{W}, {JACCARD_SQL}, l AS (SELECT DISTINCT tid AS rid, sid AS s1 FROM sp WHERE score >= 0.3 UNION SELECT 'S2-x', 'S1-unknown'), r AS (SELECT rid, count(*) AS n FROM l GROUP BY 1), o AS (SELECT s1, count(*) AS n FROM l GROUP BY 1)
SELECT (SELECT count(*) FROM r) AS n_records, (SELECT count_if(n > 1) FROM r) AS n_claimed_again, (SELECT count(*) FROM s1) AS n_s1, (SELECT count(*) FROM o) AS n_with, (SELECT count(*) FROM s1 WHERE entity_id NOT IN (SELECT s1 FROM o)) AS n_without,
(SELECT coalesce(sum(n), 0)::BIGINT FROM o WHERE s1 NOT IN (SELECT entity_id FROM s1)) AS n_unknown_owner, (SELECT count_if(n > 1) FROM r) = 0 AND (SELECT count(*) FROM o WHERE s1 NOT IN (SELECT entity_id FROM s1)) = 0 AS ok""")
def link_invariants(spark, sf_dir):
    """Unresolved links with a planted unknown owner."""
    links = _reverse(spark, sf_dir).filter("score >= 0.3").select("rid", "s1")
    planted = spark.range(1).select(F.lit("S2-x").alias("rid"), F.lit("S1-unknown").alias("s1"))
    return policy.invariants(links.unionAll(planted), blocking.sides(_norm(spark, sf_dir))[0])


@query(f"""{W}, {_PRED}, {_SCORES} SELECT name, value FROM (SELECT 'union_recall' AS name, sum(n_pred) / sum(tp)::DOUBLE AS value, 1 AS lim FROM scores UNION ALL SELECT 'f05_macro', avg(f05), 1 FROM scores) WHERE value > lim OR value < 0""")
def impossible_metrics(spark, sf_dir):
    """A recall with its quotient upside down beside a right mean."""
    s = _scores(spark, sf_dir).agg((F.sum("n_pred") / F.sum("tp")).alias("union_recall"), F.avg("f05").alias("f05_macro"))
    return policy.impossible_metrics(s.unpivot([], ["union_recall", "f05_macro"], "name", "value"))


@query(f"WITH {_P} SELECT 'S1-' || (rid % 20) AS sid, rid::VARCHAR AS tid, p2 AS score, row_number() OVER (PARTITION BY rid % 20 ORDER BY p2 DESC, rid::VARCHAR) AS rank FROM pr WHERE p2 IS NOT NULL AND NOT isnan(p2) AND p2 >= 0.6 QUALIFY rank <= 3")
def chosen_matches(spark, sf_dir):
    p = _probabilities(spark, sf_dir)
    return policy.choose_matches(p.select(F.concat(F.lit("S1-"), F.col("rid") % 20).alias("sid"), F.col("rid").cast("string").alias("tid"), F.col("p2").alias("score")), 0.6, 3)


def _f(tp: str, n: str, g: str) -> str:
    return f"CASE WHEN ({n}) = 0 AND ({g}) = 0 THEN 1.0 WHEN ({n}) = 0 OR ({g}) = 0 THEN 0.0 ELSE 5.0::DOUBLE * ({tp}) / (5 * ({tp}) + 4 * (({n}) - ({tp})) + (({g}) - ({tp}))) END"


@query(f"""{W}, {_PRED}, {_SCORES}, f AS (SELECT sid, n_pred, {_f('tp', 'n_pred', 'n_gold')} AS f, {_f('greatest(tp - 1, 0)', 'n_pred - 1', 'n_gold')} AS r, {_f('tp', 'n_pred - 1', 'n_gold')} AS w FROM scores)
SELECT sid, round(f::DOUBLE, 6) AS f05_now, round((CASE WHEN n_pred <= 0 THEN f ELSE r END)::DOUBLE, 6) AS f05_without_right, round((CASE WHEN n_pred <= 0 THEN f ELSE w END)::DOUBLE, 6) AS f05_without_wrong FROM f""")
def removal_effects(spark, sf_dir):
    return policy.after_removal(_scores(spark, sf_dir))


@query(f"""{W}, {_PRED}, {_SCORES}, m AS (SELECT avg(({_f('n_gold', 'n_gold + CASE WHEN n_gold > 0 THEN 1 ELSE 0 END', 'n_gold')})::DOUBLE) AS worse, avg(({_f('n_gold', 'n_gold', 'n_gold')})::DOUBLE) AS clean FROM scores)
SELECT p_wrong::DOUBLE AS p_wrong, round(CASE WHEN p_wrong > 0 THEN worse ELSE clean END, 6) AS f05_before, round(clean, 6) AS f05_after, round(clean - CASE WHEN p_wrong > 0 THEN worse ELSE clean END, 6) AS delta FROM m, (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3]) AS p_wrong)""")
def resolution_value(spark, sf_dir):
    return policy.resolution_value(_scores(spark, sf_dir))


@query(f"{W}, {JACCARD_SQL}, n AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS pos, count(*) OVER () AS total FROM sp) SELECT i::BIGINT AS i, score AS threshold FROM n, range(0, 60) r(i) WHERE pos = floor(i * (total - 1) / 59.0::DOUBLE + 0.5)")
def score_grid(spark, sf_dir):
    return policy.score_grid(_jaccard(spark, sf_dir))


@query("SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 500")
def seeded_sample(spark, sf_dir):
    """A sampling operator: 500 orders."""
    return policy.seeded_sample(adapters.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500, "7")


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('7:' || o_orderkey), 1, 8))::BIGINT % 50 = 0")
def hash_sample(spark, sf_dir):
    """A sampling operator: one order in 50."""
    return policy.hash_sample(adapters.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50, "7")


@query(f"{W}, g AS (SELECT sid, string_agg(DISTINCT tid, ',' ORDER BY tid) AS m FROM cand GROUP BY 1) SELECT entity_id AS source1_entity_id, coalesce(array_to_string(list_filter(string_split(coalesce(m, ''), ','), lambda t: NOT (t LIKE 'S3-%')), ','), '') AS matched_entity_ids FROM s1 LEFT JOIN g ON sid = entity_id")
def lists_without_removed(spark, sf_dir):
    norm = _norm(spark, sf_dir)
    cand = _cand(spark, sf_dir, norm)
    return policy.without(files.match_lists(blocking.sides(norm)[0], cand), cand.filter(F.col("tid").startswith("S3-")).select("sid", "tid"))


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment, NULL::DOUBLE AS acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def stacked_parties(spark, sf_dir):
    c = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), "c_mktsegment")
    s = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("acctbal"))
    return policy.stacked(c, s)


@query(f"""{W}, {JACCARD_SQL}, {BEST_SQL} SELECT b.rid, b.s1, count_if(o.p1 >= 0.9) AS c_n_hi_oth, count_if(o.p1 >= 0.3 AND left(o.rid, 2) = left(b.rid, 2)) AS c_n_same_src, count_if(o.p1 >= 0.3 AND left(o.rid, 2) <> left(b.rid, 2)) AS c_n_other_src FROM bp b LEFT JOIN bp o ON o.s1 = b.s1 AND o.rid <> b.rid GROUP BY 1, 2""")
def source_context(spark, sf_dir):
    return policy.source_context(decisions.best_pairs(_reverse(spark, sf_dir)).select("rid", "s1", "p1"))


@query(f"""{W}, {JACCARD_SQL}, {BEST_SQL}, x AS (SELECT sp.tid AS rid, sp.score * 100 AS n, CASE WHEN a.n_addr = b.n_addr THEN 100.0 ELSE 0.0 END::DOUBLE AS a FROM sp JOIN bp ON bp.rid = sp.tid AND bp.s1 <> sp.sid JOIN norm a ON a.entity_id = sp.sid JOIN norm b ON b.entity_id = sp.tid)
SELECT bp.rid, coalesce(max(a), -1.0)::DOUBLE AS max_addr, round(coalesce(max(n), -1.0)::DOUBLE, 6) AS max_name, count_if(a >= 90) AS n_addr, count_if(n >= 90) AS n_name, count_if(a >= 90 AND n >= 70) AS n_both FROM bp LEFT JOIN x ON x.rid = bp.rid GROUP BY 1""")
def candidate_competition(spark, sf_dir):
    norm = _norm(spark, sf_dir)
    scored = _reverse(spark, sf_dir)
    addr = norm.select("entity_id", "n_addr")
    pairs = scored.join(addr.toDF("s1", "x"), "s1").join(addr.toDF("rid", "y"), "rid").select("rid", "s1", (F.col("score") * 100).alias("n"), F.when(F.col("x") == F.col("y"), 100.0).otherwise(0.0).alias("a"))
    return policy.competition(decisions.best_pairs(scored), pairs, "n", "a").withColumn("max_name", F.round("max_name", 6))


@query(f"{W}, p AS (SELECT b.p_size - a.p_size AS d FROM gold JOIN pid a ON a.id = sid JOIN pid b ON b.id = tid) SELECT d::BIGINT AS d, count(*) AS n FROM p WHERE d BETWEEN -30 AND 30 GROUP BY 1")
def size_band(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part").select(F.concat(F.lit("S"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("id"), "p_size")
    rows = _gold(spark, sf_dir).join(p.toDF("sid", "a"), "sid").join(p.toDF("tid", "b"), "tid")
    return policy.band(rows, F.col("b") - F.col("a"))


@query(f"{WD} SELECT entity_id, country FROM norm ORDER BY entity_id, country LIMIT 100")
def first_records(spark, sf_dir):
    """A top-k report: the first hundred records."""
    return _norm(spark, sf_dir, adapters.docs).select("entity_id", "country").orderBy("entity_id", "country").limit(100)
