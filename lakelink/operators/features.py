"""Features of candidate pairs (pipeline A's 21, IDF overlaps and query context of pipeline B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

COLUMNS = ["name_jw", "addr_jw", "name_dl", "addr_dl", "name_exact", "addr_exact", "name_sorted_exact", "name_core_exact", "name_p2", "name_p4", "name_p6", "addr_p5", "addr_p8", "name_tok_overlap", "name_tok_jaccard", "addr_tok_overlap", "name_len_ratio", "addr_len_ratio", "country_eq", "name_digits_eq", "addr_digits_eq"]


def pair_features(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """(sid, tid, prio) with the 21 features; comparisons with a null are 0."""
    a = norm.select(*(F.col(c).alias(f"a_{c}") for c in norm.columns))
    b = norm.select(*(F.col(c).alias(f"b_{c}") for c in norm.columns))
    rows = pairs.join(a, F.col("sid") == F.col("a_entity_id")).join(b, F.col("tid") == F.col("b_entity_id"))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0)).alias
    same = lambda c: F.col(f"a_{c}") == F.col(f"b_{c}")
    start = lambda c, k: F.substring(f"a_{c}", 1, k) == F.substring(f"b_{c}", 1, k)
    overlap = lambda c: F.size(F.array_intersect(f"a_{c}", f"b_{c}")).cast("long")
    unique = F.size(F.array_union("a_name_tokens", "b_name_tokens"))

    def lengths(c: str) -> Column:
        x, y = F.length(f"a_{c}"), F.length(f"b_{c}")
        return F.coalesce(F.try_divide(F.least(x, y).cast("double"), F.greatest(x, y)), F.lit(0.0))

    pair = lambda f, c: F.round(f(F.col(f"a_{c}"), F.col(f"b_{c}")), 6)
    jw = lambda x, y: text.similarity("jaro_winkler", x, y)
    return rows.select(
        "sid", "tid", "prio", pair(jw, "n_name").alias("name_jw"), pair(jw, "n_addr").alias("addr_jw"), pair(text.damerau_similarity, "n_name").alias("name_dl"), pair(text.damerau_similarity, "n_addr").alias("addr_dl"),
        flag(same("n_name"))("name_exact"), flag(same("n_addr"))("addr_exact"), flag(same("n_sorted"))("name_sorted_exact"), flag(same("n_core_sorted"))("name_core_exact"),
        flag(start("n_name", 2))("name_p2"), flag(start("n_name", 4))("name_p4"), flag(start("n_name", 6))("name_p6"), flag(start("n_addr", 5))("addr_p5"), flag(start("n_addr", 8))("addr_p8"),
        overlap("name_tokens").alias("name_tok_overlap"), F.round(F.when(unique > 0, overlap("name_tokens") / unique).otherwise(0.0), 6).alias("name_tok_jaccard"), overlap("addr_tokens").alias("addr_tok_overlap"),
        F.round(lengths("n_name"), 6).alias("name_len_ratio"), F.round(lengths("n_addr"), 6).alias("addr_len_ratio"), flag(same("country"))("country_eq"),
        flag(F.arrays_overlap("a_name_nums", "b_name_nums"))("name_digits_eq"), flag(F.arrays_overlap("a_addr_nums", "b_addr_nums"))("addr_digits_eq"),
    )


def _dl_sql(c: str) -> str:
    return f"CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 0.0 ELSE 1 - least(1.0, damerau_levenshtein(a.{c}, b.{c}) / greatest(length(a.{c}), length(b.{c}))::DOUBLE) END"


FEATURES_SQL = f"""feat AS (SELECT sid, tid, prio, round(coalesce(jaro_winkler_similarity(a.n_name, b.n_name), 0.0), 6) AS name_jw, round(coalesce(jaro_winkler_similarity(a.n_addr, b.n_addr), 0.0), 6) AS addr_jw,
  round(({_dl_sql('n_name')})::DOUBLE, 6) AS name_dl, round(({_dl_sql('n_addr')})::DOUBLE, 6) AS addr_dl,
  coalesce((a.n_name = b.n_name)::INT, 0) AS name_exact, coalesce((a.n_addr = b.n_addr)::INT, 0) AS addr_exact, coalesce((a.n_sorted = b.n_sorted)::INT, 0) AS name_sorted_exact, coalesce((a.n_core_sorted = b.n_core_sorted)::INT, 0) AS name_core_exact,
  coalesce((left(a.n_name, 2) = left(b.n_name, 2))::INT, 0) AS name_p2, coalesce((left(a.n_name, 4) = left(b.n_name, 4))::INT, 0) AS name_p4, coalesce((left(a.n_name, 6) = left(b.n_name, 6))::INT, 0) AS name_p6,
  coalesce((left(a.n_addr, 5) = left(b.n_addr, 5))::INT, 0) AS addr_p5, coalesce((left(a.n_addr, 8) = left(b.n_addr, 8))::INT, 0) AS addr_p8,
  length(list_intersect(a.name_tokens, b.name_tokens)) AS name_tok_overlap, round(CASE WHEN length(list_distinct(list_concat(a.name_tokens, b.name_tokens))) > 0 THEN length(list_intersect(a.name_tokens, b.name_tokens)) / length(list_distinct(list_concat(a.name_tokens, b.name_tokens)))::DOUBLE ELSE 0.0 END, 6) AS name_tok_jaccard,
  length(list_intersect(a.addr_tokens, b.addr_tokens)) AS addr_tok_overlap, round(coalesce(least(length(a.n_name), length(b.n_name))::DOUBLE / nullif(greatest(length(a.n_name), length(b.n_name)), 0), 0.0), 6) AS name_len_ratio,
  round(coalesce(least(length(a.n_addr), length(b.n_addr))::DOUBLE / nullif(greatest(length(a.n_addr), length(b.n_addr)), 0), 0.0), 6) AS addr_len_ratio, coalesce((a.country = b.country)::INT, 0) AS country_eq,
  list_has_any(a.name_nums, b.name_nums)::INT AS name_digits_eq, list_has_any(a.addr_nums, b.addr_nums)::INT AS addr_digits_eq FROM cand JOIN norm a ON sid = a.entity_id JOIN norm b ON tid = b.entity_id)"""


def idf(norm: DataFrame, words: str) -> DataFrame:
    """(country, tok, df, idf) with idf = ln(N / df) within the country."""
    n = norm.groupBy("country").agg(F.count("*").alias("n"))
    df = norm.select("country", F.explode(F.array_distinct(words)).alias("tok")).groupBy("country", "tok").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), "country").select("country", "tok", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


def idf_overlap(pairs: DataFrame, norm: DataFrame, words: str, unknown: float = 12.0) -> DataFrame:
    """(sid, tid, wq, ws, wj): summed weight of common words, of all words, and their quotient."""
    weights = idf(norm, words)
    own = norm.select("entity_id", "country", F.explode(F.array_distinct(words)).alias("tok")).join(weights, ["country", "tok"], "left").select("entity_id", "tok", F.coalesce("idf", F.lit(unknown)).alias("idf"))
    total = own.groupBy("entity_id").agg(F.sum("idf").alias("total"))
    common = pairs.select("sid", "tid").join(own.withColumnRenamed("entity_id", "sid"), "sid").join(own.select(F.col("entity_id").alias("tid"), "tok"), ["tid", "tok"]).groupBy("sid", "tid").agg(F.sum("idf").alias("common"))
    rows = pairs.select("sid", "tid").join(common, ["sid", "tid"], "left").join(total.select(F.col("entity_id").alias("sid"), F.col("total").alias("ta")), "sid", "left").join(total.select(F.col("entity_id").alias("tid"), F.col("total").alias("tb")), "tid", "left")
    c, a, b = (F.coalesce(x, F.lit(0.0)) for x in ("common", "ta", "tb"))
    return rows.select("sid", "tid", F.round(c, 6).alias("wq"), F.round(a + b - c, 6).alias("ws"), F.round(F.coalesce(F.try_divide(c, a + b - c), F.lit(0.0)), 6).alias("wj"))


def query_context(pairs: DataFrame, rid: str, score: str) -> DataFrame:
    """pairs with the number of candidates, ranks (least and greatest of ties), gap to the best and number of best ones."""
    by = Window.partitionBy(rid)
    down = by.orderBy(F.desc(score))
    return pairs.withColumns({
        "q_ncand": F.count("*").over(by), "rank_min": F.rank().over(down).cast("long"), "rank_max": F.count("*").over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "gap": F.round(F.max(score).over(by) - F.col(score), 6),
    }).withColumn("n_top_ties", F.sum((F.col("gap") == 0).cast("long")).over(by))
