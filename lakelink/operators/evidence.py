"""Candidates by summed evidence of equal texts, shared words and shared 3-grams, re-ranked by fuzzy scores.

Equal names and equal second fields are never cut by a posting's size. Words and grams of large postings are
sampled by a digest, as the operator is defined, so reruns agree. Questions are distinct (name, second field)
texts, answered once however many records hold them. Of targets with equal texts only the first `top` by digest can be
among the best `top` of an exact route (their scores are equal and the evidence is bounded), so no more are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Words without weight; evidence of each route; sizes of the samples of postings; what evidence can add.
STOP = ("a", "an", "and", "the", "of", "for", "with", "to", "in", "on", "by", "pc")
WEIGHTS = {"name_word": 3.0, "gram": 0.35, "second_word": 1.5}
SAMPLES = {"name_word": 600, "gram": 1200, "second_word": 600}
EQUAL_NAME, EQUAL_SECOND, MOST_EVIDENCE, GRAM = 100.0, 95.0, 20.0, 3


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP)))


def grams(c: Column) -> Column:
    """3-grams of the text without blanks, with one blank before and after it; an empty text has none."""
    s = F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("")), F.lit(" "))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - GRAM + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(GRAM)))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(each))


def _routes() -> dict[str, Column]:
    return {"name_word": words(F.col("name")), "gram": grams(F.col("name")), "second_word": words(F.col("second"))}


def _digest(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12)


def _first(rows: DataFrame, by: list[str], order: Column, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, "tid"))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= n).drop("rn")


def evidence_candidates(left: DataFrame, right: DataFrame, dataset: str, top: int = 30, fuzzy: bool = True) -> DataFrame:
    """left and right: (entity_id, name, second), normalised; null counts as empty. The best `top` targets of each left record:
    (sid, tid, n_name_word, n_gram, n_second_word, evidence, score, rank); equal scores go by the target's digest.
    Without `fuzzy` the score is the bounded evidence alone. Left records without any text or hit have no row."""
    clean = [F.coalesce(c, F.lit("")).alias(c) for c in ("name", "second")]
    left, targets = left.select(F.col("entity_id").alias("sid"), *clean), right.select(F.col("entity_id").alias("tid"), *clean)
    asked = left.select("name", "second").distinct()
    hits = []
    for route, keys in _routes().items():
        posted = targets.select("tid", F.explode(keys).alias("key"))
        posted = _first(posted, ["key"], _digest(F.lit(dataset), "tid", "key"), SAMPLES[route])
        hits.append(asked.select("name", "second", F.explode(keys).alias("key")).join(posted, "key").select("name", "second", "tid", F.lit(route).alias("route")))
    tie = _digest("tid")
    equal_name = asked.filter("name <> ''").join(_first(targets.select("name", "tid"), ["name"], tie, top), "name")
    second = _first(targets.filter("second <> ''").select("second", F.col("name").alias("tname"), "tid"), ["second", "tname"], tie, top)
    equal_second = asked.join(second, "second")
    hits += [rows.select("name", "second", "tid", F.lit("").alias("route")) for rows in (equal_name, equal_second)]
    counts = reduce(DataFrame.unionAll, hits).groupBy("name", "second", "tid").agg(*(F.count_if(F.col("route") == r).alias(f"n_{r}") for r in WEIGHTS))
    rows = counts.join(targets.select("tid", F.col("name").alias("tname"), F.col("second").alias("tsecond")), "tid")
    same = lambda c: (F.col(c) != "") & (F.col(c) == F.col(f"t{c}"))
    base = F.when(same("name"), EQUAL_NAME).when(same("second"), EQUAL_SECOND).otherwise(0.0)
    rows = rows.withColumn("evidence", F.round(base + sum(F.col(f"n_{r}") * w for r, w in WEIGHTS.items()), 6))
    score = F.least("evidence", F.lit(MOST_EVIDENCE)) / MOST_EVIDENCE
    if fuzzy:
        rows = rows.withColumn("__s", text.similarities({"n": ("w_ratio", F.col("name"), F.col("tname")), "s": ("token_set_ratio", F.col("second"), F.col("tsecond"))}))
        score = F.greatest(F.col("__s.n"), 0.7 * F.col("__s.n") + 0.3 * F.col("__s.s")) + score
    rows = rows.withColumn("score", F.round(score, 6))
    rank = F.row_number().over(Window.partitionBy("name", "second").orderBy(F.desc("score"), tie, "tid"))
    best = rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return left.join(best, ["name", "second"]).select("sid", "tid", *(f"n_{r}" for r in WEIGHTS), "evidence", "score", "rank")


def evidence_sql(dataset: str, top: int = 30) -> str:
    """Without fuzzy scores, on lf and rt (entity_id, name, second)."""
    stop = ", ".join(f"'{w}'" for w in STOP)
    word = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda w: length(w) >= 2 AND w NOT IN ({stop})))"
    z = "' ' || replace(name, ' ', '') || ' '"
    gram = f"CASE WHEN name = '' THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, length({z}) - 1), lambda i: substr({z}, i, 3))) END"
    keys = lambda t: f"SELECT entity_id, name, second, 'name_word' AS route, unnest({word('name')}) AS key FROM {t} UNION ALL SELECT entity_id, name, second, 'gram', unnest({gram}) FROM {t} UNION ALL SELECT entity_id, name, second, 'second_word', unnest({word('second')}) FROM {t}"
    caps = "CASE route " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in SAMPLES.items()) + " END"
    return f"""lk AS ({keys('lf')}), rk0 AS ({keys('rt')}), po AS (SELECT route, key, entity_id AS tid FROM (SELECT *, row_number() OVER (PARTITION BY route, key ORDER BY substr(sha256('{dataset}:' || entity_id || ':' || key), 1, 12), entity_id) AS rn FROM rk0) WHERE rn <= {caps}),
ht AS (SELECT lk.entity_id AS sid, tid, lk.route FROM lk JOIN po ON po.route = lk.route AND po.key = lk.key UNION ALL SELECT a.entity_id, b.entity_id, '' FROM lf a JOIN rt b ON a.name = b.name AND a.name <> '' UNION ALL SELECT a.entity_id, b.entity_id, '' FROM lf a JOIN rt b ON a.second = b.second AND a.second <> ''),
ct AS (SELECT sid, tid, {', '.join(f"count(CASE WHEN route = '{r}' THEN 1 END) AS n_{r}" for r in WEIGHTS)} FROM ht GROUP BY 1, 2),
ev AS (SELECT ct.*, round((CASE WHEN a.name <> '' AND a.name = b.name THEN {EQUAL_NAME} WHEN a.second <> '' AND a.second = b.second THEN {EQUAL_SECOND} ELSE 0 END + {' + '.join(f'{w} * n_{r}' for r, w in WEIGHTS.items())})::DOUBLE, 6) AS evidence FROM ct JOIN lf a ON a.entity_id = sid JOIN rt b ON b.entity_id = tid),
es AS (SELECT *, round(least(evidence, {MOST_EVIDENCE}) / {MOST_EVIDENCE}::DOUBLE, 6) AS score FROM ev), gq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, substr(sha256(tid), 1, 12), tid) AS rank FROM es) WHERE rank <= {top})"""
