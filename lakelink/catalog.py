"""All queries of the linkage operators, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import blocking, decisions, features, metrics, normalize, profile, scoring
from .sources import adapters, files

FLAGSHIP = "exact_name_links"
QUERIES: dict = {}
ORACLES: dict = {}
GRID = [i / 20 for i in range(1, 20)]


def _counts(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END), which is a BIGINT in DuckDB too."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _counts(sql)
        return f

    return add


def _norm(spark: SparkSession, sf_dir: str, adapter=adapters.parts) -> DataFrame:
    return normalize.normalized(adapter(spark, sf_dir))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known links of the parts adapter: parts of equal name, brand and type, from S1 to S2 and S3."""
    p = adapters.table(spark, sf_dir, "part").select(F.concat(F.lit("S"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("id"), "p_name", "p_brand", "p_type", "p_size")
    a, b = p.filter(F.col("id").startswith("S1-")).withColumnRenamed("id", "sid"), p.filter(~F.col("id").startswith("S1-")).withColumnRenamed("id", "tid")
    return a.drop("p_size").join(b.drop("p_size"), ["p_name", "p_brand", "p_type"]).select("sid", "tid")


GOLD_SQL = """pid AS (SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS id, p_name, p_brand, p_type, p_size FROM part),
gold AS (SELECT a.id AS sid, b.id AS tid FROM pid a JOIN pid b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type WHERE a.id LIKE 'S1-%' AND b.id NOT LIKE 'S1-%')"""
W = f"WITH {adapters.PARTS_SQL}, {normalize.NORM_SQL}, {blocking.SIDES_SQL}, {blocking.POSTINGS_SQL}, {blocking.PAIRS_SQL}, {blocking.candidates_sql()}, {GOLD_SQL}"
WD = f"WITH {adapters.DOCS_SQL}, {normalize.NORM_SQL}, {blocking.SIDES_SQL}"
WP = f"WITH {adapters.PEOPLE_SQL}, {normalize.NORM_SQL}, {blocking.SIDES_SQL}"


def _cand(spark, sf_dir, norm=None) -> DataFrame:
    return blocking.candidates(blocking.channel_pairs(_norm(spark, sf_dir) if norm is None else norm, first=blocking.MAX_CANDIDATES))


@query(f"{WD} SELECT entity_id, country, n_name, n_addr, n_sorted, n_core_sorted, a_sorted, array_to_string(name_tokens, '|') AS name_tokens, array_to_string(addr_tokens, '|') AS addr_tokens, array_to_string(name_nums, '|') AS name_nums, array_to_string(addr_nums, '|') AS addr_nums FROM norm")
def normalized_records(spark, sf_dir):
    rows = _norm(spark, sf_dir, adapters.docs)
    return rows.select("entity_id", "country", "n_name", "n_addr", "n_sorted", "n_core_sorted", "a_sorted", *(F.array_join(c, "|").alias(c) for c in ("name_tokens", "addr_tokens", "name_nums", "addr_nums")))


@query(f"""{WD}, kept AS (SELECT * FROM (SELECT a.entity_id AS sid, b.entity_id AS tid, row_number() OVER (PARTITION BY a.entity_id ORDER BY b.entity_id) AS rn FROM s1 a JOIN tg b ON a.country = b.country AND a.n_name = b.n_name) WHERE rn <= 10)
SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT tid, ',' ORDER BY tid), '') AS matched_entity_ids FROM s1 LEFT JOIN kept ON sid = s1.entity_id GROUP BY 1""")
def exact_name_links(spark, sf_dir):
    s1, targets = blocking.sides(_norm(spark, sf_dir, adapters.docs))
    left = s1.filter("n_name IS NOT NULL").select(F.col("entity_id").alias("sid"), "country", "n_name")
    first = blocking.least(targets.filter("n_name IS NOT NULL").select(F.col("entity_id").alias("tid"), "country", "n_name"), ["country", "n_name"], 10)
    return files.match_lists(s1, left.join(first, ["country", "n_name"]))  # a sid has one name, so at most ten targets


@query(f"{W} SELECT kind, token, df, count(*) AS n_postings, count(DISTINCT country) AS n_countries FROM postings GROUP BY ALL")
def token_postings(spark, sf_dir):
    _, targets = blocking.sides(_norm(spark, sf_dir))
    return blocking.token_postings(targets).groupBy("kind", "token", "df").agg(F.count("*").alias("n_postings"), F.count_distinct("country").alias("n_countries"))


@query(f"{W} SELECT sid, tid, prio::INT AS prio FROM cand")
def candidate_pairs(spark, sf_dir):
    return _cand(spark, sf_dir)


@query(f"{W} SELECT c.prio::INT AS prio, c.n_raw, coalesce(k.n_kept, 0) AS n_kept FROM (SELECT prio, count(*) AS n_raw FROM pairs GROUP BY 1) c LEFT JOIN (SELECT prio, count(*) AS n_kept FROM cand GROUP BY 1) k USING (prio)")
def channel_accounting(spark, sf_dir):
    norm = _norm(spark, sf_dir)
    raw = blocking.channel_volume(norm)
    kept = _cand(spark, sf_dir, norm).groupBy("prio").agg(F.count("*").alias("n_kept"))
    return raw.join(kept, "prio", "left").select("prio", "n_raw", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query(f"{W}, per AS (SELECT sid, count(*) AS n FROM cand GROUP BY 1) SELECT count(*) AS n_s1, sum(n)::BIGINT AS n_pairs, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS most FROM per")
def candidate_quantiles(spark, sf_dir):
    per = _cand(spark, sf_dir).groupBy("sid").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_s1"), F.sum("n").alias("n_pairs"), F.round(F.percentile("n", 0.5), 6).alias("p50"), F.round(F.percentile("n", 0.9), 6).alias("p90"), F.max("n").alias("most"))


@query(f"{W}, {features.FEATURES_SQL} SELECT sid, tid, prio::INT AS prio, {', '.join(features.COLUMNS)} FROM feat")
def pair_features(spark, sf_dir):
    norm = _norm(spark, sf_dir)
    return features.pair_features(_cand(spark, sf_dir, norm), norm)


@query(f"WITH {adapters.PARTS_SQL}, {normalize.NORM_SQL}, {blocking.KEY_RECORDS_SQL}, {blocking.scored_sql()} SELECT * FROM scored")
def scored_candidates(spark, sf_dir):
    return blocking.scored_candidates(blocking.key_records(_norm(spark, sf_dir)))


@query(f"WITH {adapters.DOCS_SQL}, {normalize.NORM_SQL}, {blocking.KEY_RECORDS_SQL}, {blocking.scored_sql()} SELECT * FROM scored")
def scored_documents(spark, sf_dir):
    return blocking.scored_candidates(blocking.key_records(_norm(spark, sf_dir, adapters.docs)))


@query(f"{W}, own AS (SELECT country, unnest(list_distinct(name_tokens)) AS tok FROM norm), nn AS (SELECT country, count(*) AS n FROM norm GROUP BY 1) SELECT country, tok, count(*) AS df, round(ln(any_value(n) / count(*)::DOUBLE), 6) AS idf FROM own JOIN nn USING (country) GROUP BY country, tok")
def idf_table(spark, sf_dir):
    return features.idf(_norm(spark, sf_dir), "name_tokens")


@query(f"""{W}, ow AS (SELECT DISTINCT entity_id, country, unnest(name_tokens) AS tok FROM norm), nn AS (SELECT country, count(*) AS n FROM norm GROUP BY 1),
id AS (SELECT country, tok, round(ln(any_value(n) / count(*)::DOUBLE), 6) AS idf FROM ow JOIN nn USING (country) GROUP BY country, tok), wt AS (SELECT entity_id, tok, coalesce(idf, 12) AS idf FROM ow LEFT JOIN id USING (country, tok)),
tot AS (SELECT entity_id, sum(idf) AS t FROM wt GROUP BY 1), com AS (SELECT sid, tid, sum(a.idf) AS c FROM cand JOIN wt a ON a.entity_id = sid JOIN wt b ON b.entity_id = tid AND a.tok = b.tok GROUP BY 1, 2)
SELECT sid, tid, round(coalesce(c, 0), 6) AS wq, round(coalesce(x.t, 0) + coalesce(y.t, 0) - coalesce(c, 0), 6) AS ws, round(coalesce(coalesce(c, 0) / nullif(coalesce(x.t, 0) + coalesce(y.t, 0) - coalesce(c, 0), 0), 0), 6) AS wj
FROM cand LEFT JOIN com USING (sid, tid) LEFT JOIN tot x ON x.entity_id = sid LEFT JOIN tot y ON y.entity_id = tid""")
def idf_overlap(spark, sf_dir):
    norm = _norm(spark, sf_dir)
    return features.idf_overlap(_cand(spark, sf_dir, norm), norm, "name_tokens")


@query(f"""WITH {adapters.PARTS_SQL}, {normalize.NORM_SQL}, {blocking.KEY_RECORDS_SQL}, {blocking.scored_sql()} SELECT rid, s1, bscore, count(*) OVER (PARTITION BY rid) AS q_ncand, rank() OVER (PARTITION BY rid ORDER BY bscore DESC) AS rank_min,
count(*) OVER (PARTITION BY rid ORDER BY bscore DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank_max, round(max(bscore) OVER (PARTITION BY rid) - bscore, 6) AS gap, count_if(bscore = top) OVER (PARTITION BY rid) AS n_top_ties FROM (SELECT *, max(bscore) OVER (PARTITION BY rid) AS top FROM scored)""")
def query_context(spark, sf_dir):
    return features.query_context(blocking.scored_candidates(blocking.key_records(_norm(spark, sf_dir))).select("rid", "s1", "bscore"), "rid", "bscore")


@query(f"{W} SELECT sid, count(*) AS n_links FROM gold GROUP BY 1")
def gold_links(spark, sf_dir):
    lists = files.match_lists(blocking.sides(_norm(spark, sf_dir))[0], _gold(spark, sf_dir))
    return files.edges(lists).groupBy("sid").agg(F.count("*").alias("n_links"))


_SCORES = """both_ AS (SELECT coalesce(p.sid, g.sid) AS sid, p.tid IS NOT NULL AS p, g.tid IS NOT NULL AS g FROM (SELECT DISTINCT sid, tid FROM pred) p FULL JOIN (SELECT DISTINCT sid, tid FROM gold) g ON p.sid = g.sid AND p.tid = g.tid),
cnt AS (SELECT sid, count_if(p AND g) AS tp, count_if(p) AS n_pred, count_if(g) AS n_gold FROM both_ GROUP BY 1), full_ AS (SELECT entity_id AS sid, country, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_gold, 0) AS n_gold FROM s1 LEFT JOIN cnt ON cnt.sid = entity_id),
scores AS (SELECT *, round(CASE WHEN n_pred = 0 AND n_gold = 0 THEN 1.0 WHEN n_pred = 0 OR n_gold = 0 THEN 0.0 ELSE 5.0::DOUBLE * tp / (5 * tp + 4 * (n_pred - tp) + (n_gold - tp)) END::DOUBLE, 6) AS f05 FROM full_)"""
_PRED = "pred AS (SELECT sid, tid FROM cand WHERE prio <= 3)"


def _scores(spark, sf_dir) -> DataFrame:
    norm = _norm(spark, sf_dir)
    return metrics.entity_scores(blocking.sides(norm)[0], _cand(spark, sf_dir, norm).filter("prio <= 3"), _gold(spark, sf_dir))


@query(f"{W}, {_PRED}, {_SCORES} SELECT sid, country, tp, n_pred, n_gold, f05 FROM scores")
def entity_f05(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(f"{W}, {_PRED}, {_SCORES} SELECT count(*) AS n, round(avg(f05), 6) AS macro_f05, sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred, sum(n_gold)::BIGINT AS n_gold FROM scores")
def macro_f05(spark, sf_dir):
    return metrics.macro(_scores(spark, sf_dir))


@query(f"{W}, {_PRED}, {_SCORES} SELECT country, count(*) AS n, round(avg(f05), 6) AS macro_f05, sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred, sum(n_gold)::BIGINT AS n_gold FROM scores GROUP BY country")
def macro_f05_by_country(spark, sf_dir):
    return metrics.macro(_scores(spark, sf_dir), "country")


@query(f"{W} SELECT left(g.tid, 2) AS source, count(*) AS n_gold, count(c.tid) AS n_found, round(count(c.tid) / count(*)::DOUBLE, 6) AS recall FROM (SELECT DISTINCT sid, tid FROM gold) g LEFT JOIN cand c ON c.sid = g.sid AND c.tid = g.tid GROUP BY 1")
def blocking_recall(spark, sf_dir):
    return metrics.blocking_recall(_cand(spark, sf_dir), _gold(spark, sf_dir))


@query(f"{W}, best0 AS (SELECT sid, tid, min(prio) AS prio FROM pairs GROUP BY 1, 2), rk AS (SELECT b.*, row_number() OVER (PARTITION BY b.sid ORDER BY prio, b.tid) AS rn, g.tid IS NOT NULL AS g FROM best0 b LEFT JOIN (SELECT DISTINCT sid, tid FROM gold) g ON g.sid = b.sid AND g.tid = b.tid) SELECT cap::BIGINT AS cap, count_if(rn <= cap) AS n_pairs, count_if(rn <= cap AND g) AS n_found FROM rk, (SELECT unnest([3, 5, 6, 8, 10, 15, 20]) AS cap) GROUP BY cap")
def cap_curve(spark, sf_dir):
    return profile.cap_curve(blocking.channel_pairs(_norm(spark, sf_dir), first=max(profile.CURVE_CAPS)), _gold(spark, sf_dir))


def _jaccard(spark, sf_dir) -> DataFrame:
    """Scored pairs without Python: Jaccard of name words with a part for equal addresses."""
    norm = _norm(spark, sf_dir)
    a, b = (norm.select(F.col("entity_id").alias(i), F.col("name_tokens").alias(f"t_{i}"), F.col("n_addr").alias(f"d_{i}")) for i in ("sid", "tid"))
    rows = _cand(spark, sf_dir, norm).join(a, "sid").join(b, "tid")
    j = F.size(F.array_intersect("t_sid", "t_tid")) / F.greatest(F.size(F.array_union("t_sid", "t_tid")), F.lit(1))
    return rows.select("sid", "tid", F.round(0.8 * j + F.when(F.col("d_sid") == F.col("d_tid"), 0.2).otherwise(0.0), 4).alias("score"))


JACCARD_SQL = "sp AS (SELECT sid, tid, round((0.8::DOUBLE * length(list_intersect(a.name_tokens, b.name_tokens)) / greatest(length(list_distinct(list_concat(a.name_tokens, b.name_tokens))), 1) + CASE WHEN a.n_addr = b.n_addr THEN 0.2 ELSE 0 END)::DOUBLE, 4) AS score FROM cand JOIN norm a ON a.entity_id = sid JOIN norm b ON b.entity_id = tid)"


@query(f"""{W}, {JACCARD_SQL}, gr AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) r(i)), pr AS (SELECT threshold, sid, tid FROM sp, gr WHERE score >= threshold), g1 AS (SELECT DISTINCT sid, tid FROM gold),
cn AS (SELECT t.threshold, s1.entity_id AS sid, (SELECT count(*) FROM pr WHERE pr.threshold = t.threshold AND pr.sid = s1.entity_id) AS n_pred, (SELECT count(*) FROM pr JOIN g1 USING (sid, tid) WHERE pr.threshold = t.threshold AND pr.sid = s1.entity_id) AS tp, (SELECT count(*) FROM g1 WHERE g1.sid = s1.entity_id) AS n_gold FROM s1, gr t)
SELECT threshold, round(avg(CASE WHEN n_pred = 0 AND n_gold = 0 THEN 1.0 WHEN n_pred = 0 OR n_gold = 0 THEN 0.0 ELSE 5.0::DOUBLE * tp / (5 * tp + 4 * (n_pred - tp) + (n_gold - tp)) END::DOUBLE), 6) AS macro_f05, sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred FROM cn GROUP BY 1""")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(blocking.sides(_norm(spark, sf_dir))[0], _jaccard(spark, sf_dir), _gold(spark, sf_dir), GRID)


def _reverse(spark, sf_dir) -> DataFrame:
    return _jaccard(spark, sf_dir).select(F.col("tid").alias("rid"), F.col("sid").alias("s1"), "score")


@query(f"{W}, {JACCARD_SQL} SELECT rid, s1, score FROM (SELECT tid AS rid, sid AS s1, score, row_number() OVER (PARTITION BY tid ORDER BY score DESC, sid) AS rn FROM sp WHERE score >= 0.3) WHERE rn = 1")
def resolved_conflicts(spark, sf_dir):
    return decisions.resolve_conflicts(_reverse(spark, sf_dir), 0.3)


BEST_SQL = "bp AS (SELECT rid, s1, score AS p1, coalesce(nxt, 0.0)::DOUBLE AS p1_2nd, round((score - coalesce(nxt, 0.0))::DOUBLE, 6) AS p1_margin, n_gt01, n_all FROM (SELECT tid AS rid, sid AS s1, score, lead(score) OVER o AS nxt, row_number() OVER o AS rn, count(*) OVER (PARTITION BY tid) AS n_all, count_if(score > 0.1) OVER (PARTITION BY tid) AS n_gt01 FROM sp WINDOW o AS (PARTITION BY tid ORDER BY score DESC, sid)) WHERE rn = 1)"


@query(f"{W}, {JACCARD_SQL}, {BEST_SQL} SELECT * FROM bp")
def best_pairs(spark, sf_dir):
    return decisions.best_pairs(_reverse(spark, sf_dir))


@query(f"""{W}, {JACCARD_SQL}, {BEST_SQL}, mem AS (SELECT * FROM bp WHERE p1 >= 0.5) SELECT b.rid, b.s1, b.p1, count(m.rid) AS c_n_oth, round(coalesce(sum(m.p1), 0.0)::DOUBLE, 6) AS c_sum_oth, coalesce(max(m.p1), 0.0)::DOUBLE AS c_max_oth FROM bp b LEFT JOIN mem m ON m.s1 = b.s1 AND m.rid <> b.rid GROUP BY 1, 2, 3""")
def cluster_context(spark, sf_dir):
    return decisions.context(decisions.best_pairs(_reverse(spark, sf_dir)).select("rid", "s1", "p1"))


_P = "pr AS (SELECT doc_id AS rid, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'NaN'::DOUBLE ELSE (n_chars % 100) / 100.0::DOUBLE END AS p2, CASE WHEN doc_id % 11 = 0 THEN 0.01 ELSE 0.5 END::DOUBLE AS p1 FROM documents)"
_DECIDE = "CASE WHEN p2 IS NULL OR p1 IS NULL THEN 'NO_CANDIDATE' WHEN isnan(p1) OR isnan(p2) THEN 'ABSTAIN' WHEN p1 < 0.02 THEN 'NO_CANDIDATE' WHEN p2 >= {t} THEN 'MATCH' ELSE 'ABSTAIN' END"


def _probabilities(spark, sf_dir) -> DataFrame:
    d = adapters.table(spark, sf_dir, "documents")
    p2 = F.when(F.col("doc_id") % 17 == 0, None).when(F.col("doc_id") % 13 == 0, float("nan")).otherwise((F.col("n_chars") % 100) / 100.0)
    return d.select(F.col("doc_id").alias("rid"), p2.cast("double").alias("p2"), F.when(F.col("doc_id") % 11 == 0, 0.01).otherwise(0.5).alias("p1"))


@query(f"WITH {_P} SELECT rid, {_DECIDE.format(t=0.65)} AS decision, CASE WHEN p2 IS NULL OR isnan(p2) THEN 'very_low' WHEN p2 >= 0.9 THEN 'very_high' WHEN p2 >= 0.7 THEN 'high' WHEN p2 >= 0.4 THEN 'medium' WHEN p2 >= 0.1 THEN 'low' ELSE 'very_low' END AS confidence FROM pr")
def typed_decisions(spark, sf_dir):
    return _probabilities(spark, sf_dir).select("rid", decisions.decide(F.col("p2"), F.col("p1"), 0.65).alias("decision"), decisions.bucket(F.col("p2")).alias("confidence"))


@query(f"WITH {_P}, d AS (SELECT threshold, {_DECIDE.format(t='threshold')} AS d FROM pr, (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) r(i))) SELECT threshold, count_if(d = 'MATCH') AS n_match, count_if(d = 'ABSTAIN') AS n_abstain, count_if(d = 'NO_CANDIDATE') AS n_no_candidate FROM d GROUP BY 1")
def policy_sweep(spark, sf_dir):
    return decisions.sweep(_probabilities(spark, sf_dir), GRID)


@query(f"{W} SELECT entity_id, CASE WHEN n_core_sorted IS NOT NULL THEN count(*) OVER (PARTITION BY country, n_core_sorted) ELSE 0 END AS name_dups, CASE WHEN a_sorted IS NOT NULL THEN count(*) OVER (PARTITION BY country, a_sorted) ELSE 0 END AS addr_dups FROM norm")
def entity_duplicates(spark, sf_dir):
    return decisions.duplicates(_norm(spark, sf_dir))


@query(f"""{W}, h AS (SELECT c.sid, c.tid, try_cast(nullif(regexp_extract(b.business_address, '(?:^|[\\s,#])0*(\\d{{1,6}})(?:[A-Za-z]?\\b|[-/ ])', 1), '') AS BIGINT) - try_cast(nullif(regexp_extract(a.business_address, '(?:^|[\\s,#])0*(\\d{{1,6}})(?:[A-Za-z]?\\b|[-/ ])', 1), '') AS BIGINT) AS d FROM cand c JOIN src a ON a.entity_id = c.sid JOIN src b ON b.entity_id = c.tid),
x AS (SELECT *, CASE WHEN d IS NOT NULL THEN count(*) OVER (PARTITION BY sid, d) ELSE 0 END AS shared FROM h) SELECT sid, tid, d, shared, coalesce(d IN (3, 4, 5, 7, 9, 11, 13, 21) AND shared = 1, false) AS removed FROM x""")
def offset_rule(spark, sf_dir):
    src = adapters.parts(spark, sf_dir).select("entity_id", "business_address")
    rows = _cand(spark, sf_dir).select("sid", "tid").join(src.select(F.col("entity_id").alias("sid"), F.col("business_address").alias("aa")), "sid").join(src.select(F.col("entity_id").alias("tid"), F.col("business_address").alias("ab")), "tid")
    return decisions.offset_rule(rows, "aa", "ab").select("sid", "tid", "d", "shared", "removed")


@query(f"""{W}, m0 AS (SELECT sid, tid FROM cand WHERE prio <= 4 AND right(sid, 1) <> '0'), bad AS (SELECT sid, tid FROM m0 UNION ALL SELECT 'S1-none', 'S2-none' UNION ALL SELECT min(sid), 'X9-1' FROM m0 UNION ALL SELECT 'S1-twice', 'S2-q' UNION ALL SELECT 'S1-twice', 'S3-q'), ids AS (SELECT DISTINCT sid FROM bad),
c0 AS (SELECT sid, tid FROM cand WHERE prio <= 3)
SELECT 'duplicate rows' AS problem, 1::BIGINT AS n UNION ALL SELECT 'missing entities', count(*) FROM s1 WHERE entity_id NOT IN (SELECT sid FROM ids) UNION ALL SELECT 'unknown entities', count(*) FROM ids WHERE sid NOT IN (SELECT entity_id FROM s1)
UNION ALL SELECT 'duplicate matches', 1 UNION ALL SELECT 'bad prefix', count(*) FROM bad WHERE NOT (tid LIKE 'S2-%' OR tid LIKE 'S3-%') UNION ALL SELECT 'absent targets', count(DISTINCT tid) FROM bad WHERE tid NOT IN (SELECT entity_id FROM tg)
UNION ALL SELECT 'matches beyond candidates', count(*) FROM (SELECT sid, tid FROM bad EXCEPT SELECT sid, tid FROM c0)""")
def validation(spark, sf_dir):
    """A result with planted faults: a repeated entity and match, entities left out, an unknown one, a bad target, matches beyond the candidates."""
    norm = _norm(spark, sf_dir)
    s1, targets = blocking.sides(norm)
    cand = _cand(spark, sf_dir, norm)
    m = cand.filter("prio <= 4 AND right(sid, 1) <> '0'").select("sid", "tid")
    bad = m.unionAll(spark.range(1).select(F.lit("S1-none").alias("sid"), F.lit("S2-none").alias("tid"))).unionAll(m.agg(F.min("sid").alias("sid")).select("sid", F.lit("X9-1").alias("tid")))
    lists = bad.groupBy("sid").agg(F.array_join(F.array_sort(F.collect_set("tid")), ",").alias("matched_entity_ids")).withColumnRenamed("sid", "source1_entity_id")
    twice = spark.range(2).select(F.lit("S1-twice").alias("source1_entity_id"), F.when(F.col("id") == 0, "S2-q,S2-q").otherwise("S3-q").alias("matched_entity_ids"))
    return metrics.violations(s1, targets, lists.unionByName(twice), files.match_lists(s1, cand.filter("prio <= 3"), "candidate_entity_ids"))


@query(f"{WD} {profile.COUNTERS_SQL}")
def profile_counters(spark, sf_dir):
    return profile.counters(adapters.docs(spark, sf_dir))


@query(f"{WD} SELECT country, (length(coalesce(business_name, '')) // 10 * 10)::BIGINT AS from_length, count(*) AS n FROM src GROUP BY ALL")
def length_histogram(spark, sf_dir):
    return profile.histogram(adapters.docs(spark, sf_dir), "business_name")


@query(f"{WD} SELECT country, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, token) AS rank FROM (SELECT country, token, count(*) AS n FROM (SELECT country, unnest(name_tokens) AS token FROM norm) GROUP BY ALL)) WHERE rank <= 10")
def top_tokens(spark, sf_dir):
    return profile.top_tokens(_norm(spark, sf_dir, adapters.docs), "name_tokens")


_KEYS = ["n_name", "n_core_sorted", "a_sorted"]


@query(f"{WD} {profile.duplicate_sql(_KEYS)}")
def duplicate_stats(spark, sf_dir):
    return profile.duplicate_stats(_norm(spark, sf_dir, adapters.docs), _KEYS)


@query(f"{W}, e AS (SELECT DISTINCT sid, tid FROM gold) SELECT 'sid' AS side, degree, count(*) AS n FROM (SELECT sid, count(*) AS degree FROM e GROUP BY 1) GROUP BY degree UNION ALL SELECT 'tid', degree, count(*) FROM (SELECT tid, count(*) AS degree FROM e GROUP BY 1) GROUP BY degree")
def degree_histogram(spark, sf_dir):
    return profile.degrees(_gold(spark, sf_dir))


_LIVE = ["n_name", "n_addr", "n_sorted", "n_core_sorted", "a_sorted", "name_tokens", "addr_tokens", "name_nums", "addr_nums"]


def _live_sql() -> str:
    one = lambda f: f"SELECT '{f}' AS field, round(count_if({f'length({f}) > 0' if f.endswith(('tokens', 'nums')) else f + ' IS NOT NULL'}) / count(*)::DOUBLE, 6) AS share FROM norm"
    return f"{WP} SELECT field, share, CASE WHEN share < 0.01 THEN 'DEAD' WHEN share < 0.25 THEN 'WEAK' ELSE 'LIVE' END AS state FROM ({' UNION ALL '.join(map(one, _LIVE))})"


@query(_live_sql())
def field_liveness(spark, sf_dir):
    return profile.liveness(_norm(spark, sf_dir, adapters.people))


@query(f"{W}, {profile.KEY_FAMILIES_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS family, n, {f} AS n_found FROM fam" for f in profile.FAMILIES))
def key_families(spark, sf_dir):
    return profile.key_families(_norm(spark, sf_dir), _gold(spark, sf_dir))


@query(f"{W} {profile.volume_sql()}")
def key_volume(spark, sf_dir):
    return profile.key_volume(_norm(spark, sf_dir))


@query(f"{WP}, l AS (SELECT country, trim(split_part(coalesce(business_address, ''), ',', -1)) AS x FROM src) SELECT country, CASE WHEN x = '' THEN 'empty' WHEN regexp_matches(x, '^[0-9]{{5}}$') THEN 'digits5' WHEN regexp_matches(x, '^[0-9]{{5}}-?[0-9]{{4}}$') THEN 'digits9' WHEN regexp_matches(x, '[0-9]') THEN 'digits' WHEN regexp_matches(x, '^[A-Za-z]{{2}}$') THEN 'letters2' ELSE 'text' END AS shape, count(*) AS n FROM l GROUP BY ALL")
def trailing_shapes(spark, sf_dir):
    return profile.shapes(adapters.people(spark, sf_dir), "business_address")


@query("""WITH c AS (SELECT p_name AS grp, p_type AS v, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS total, row_number() OVER (PARTITION BY grp ORDER BY n DESC, v) AS rn FROM c), b AS (SELECT p_type AS v, count(*) AS of_all FROM part GROUP BY 1)
SELECT grp, t.v AS top_value, n, total::BIGINT AS total, round(n / total::DOUBLE, 6) AS share, round(of_all / (SELECT count(*) FROM part)::DOUBLE, 6) AS base_rate, n / total::DOUBLE >= 3 * (of_all / (SELECT count(*) FROM part)::DOUBLE) AS associated FROM t JOIN b USING (v) WHERE rn = 1 AND total >= 20""")
def value_association(spark, sf_dir):
    return profile.association(adapters.table(spark, sf_dir, "part"), "p_name", "p_type")


@query("SELECT c_custkey, (('0x' || substr(md5('S1-' || c_custkey), 1, 8))::BIGINT % 100) AS bucket, CASE WHEN ('0x' || substr(md5('S1-' || c_custkey), 1, 8))::BIGINT % 100 < 3 THEN 'V' WHEN ('0x' || substr(md5('S1-' || c_custkey), 1, 8))::BIGINT % 100 < 7 THEN 'T' ELSE '-' END AS split FROM customer")
def hash_splits(spark, sf_dir):
    b = normalize.sample_bucket(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")), 100)
    return adapters.table(spark, sf_dir, "customer").select("c_custkey", b.alias("bucket"), F.when(b < 3, "V").when(b < 7, "T").otherwise("-").alias("split"))


@query("""SELECT e.event_id, e.user_id, row_number() OVER w AS rn, lead(value) OVER w AS runner_up, round(value - lead(value) OVER w, 6) AS margin, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rank_min FROM events e WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)""")
def runner_up_margin(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return e.select("event_id", "user_id", F.row_number().over(w).cast("long").alias("rn"), F.lead("value").over(w).alias("runner_up"), F.round(F.col("value") - F.lead("value").over(w), 6).alias("margin"), F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long").alias("rank_min"))


@query()
def fuzzy_ratios(spark, sf_dir):
    """Scorers that SQL lacks, on distinct names of candidate pairs; unit tests hold them against their definitions."""
    norm = _norm(spark, sf_dir)
    names = [norm.select(F.col("entity_id").alias(i), F.col("n_name").alias(c)) for i, c in (("sid", "a"), ("tid", "b"))]
    rows = _cand(spark, sf_dir, norm).select("sid", "tid").join(names[0], "sid").join(names[1], "tid").select("a", "b").distinct()
    kinds = ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "w_ratio")
    rows = rows.withColumn("s", text.similarities({n: (n, F.col("a"), F.col("b")) for n in kinds}))
    return rows.select("a", "b", *(F.round(F.col("s")[n], 4).alias(n) for n in kinds), text.soundex_column(F.substring_index("a", " ", 1)).alias("soundex"))


@query()
def logistic_links(spark, sf_dir):
    """Fitted scorer and tuned threshold applied to all pairs (numbers depend on the optimiser: no SQL)."""
    norm = _norm(spark, sf_dir)
    feat = features.pair_features(_cand(spark, sf_dir, norm), norm)
    weights, intercept, threshold = scoring.fit_and_tune(feat, _gold(spark, sf_dir), norm, features.COLUMNS)
    p = scoring.sigmoid(scoring.linear(weights, intercept))
    return feat.select("sid", "tid", F.round(p, 6).alias("score"), (p >= threshold).alias("linked"))
