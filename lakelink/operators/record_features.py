"""Features of (target, Source 1) pairs from parsed records (pipeline B's groups FB1 to FB14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .normalize import core_tokens, tokens

# Legal forms, weight of a word that no table knows, least share of the best blocking score.
LEGAL = ("pvt", "ltd", "corp", "inc", "co", "llc", "llp", "lp", "plc", "pc", "pllc", "sarl", "sas", "sasu", "eurl", "sa", "ei", "sci", "snc", "scop", "selarl", "opc")
UNKNOWN_IDF, LEAST_SHARE = 12.0, 0.3
LISTS = ("name_full", "name_core", "name_alt", "addr_words", "addr_numbers", "city")
FLAGS = ("is_domain", "is_dba", "is_native")


def plain_records(norm: DataFrame) -> DataFrame:
    """Records of the features from normalised entities, without dictionaries: the state is the last word of the address, the
    city the address without words that hold a digit, the postal code a number of six digits."""
    name, addr = tokens(F.col("n_name")), tokens(F.col("n_addr"))
    none, no = F.array().cast("array<string>"), F.lit(False)
    place = F.array_join(F.filter(addr, lambda w: ~w.rlike("[0-9]")), " ")
    return norm.select(
        "entity_id", "country", name.alias("name_full"), core_tokens(name).alias("name_core"), none.alias("name_alt"), addr.alias("addr_words"), F.col("addr_nums").alias("addr_numbers"),
        F.when(place != "", F.array(place)).otherwise(none).alias("city"), F.coalesce(F.try_element_at(addr, F.lit(-1)), F.lit("")).alias("state"),
        F.coalesce(F.try_element_at(F.filter("addr_nums", lambda n: F.length(n) == 6), F.lit(-1)), F.lit("")).alias("pin"), no.alias("is_domain"), no.alias("is_dba"), no.alias("is_native"),
    )


def weighted_words(records: DataFrame, column: str) -> DataFrame:
    """(entity_id, words): the distinct words of each record with ln(N / df) of its country, once a record, so that
    pairs compare two short lists instead of being listed word by word."""
    by_country = records.groupBy("country").agg(F.count("*").alias("n"))
    own = records.select("entity_id", "country", F.explode(F.array_distinct(F.filter(column, lambda w: w != ""))).alias("t"))
    idf = own.groupBy("country", "t").agg(F.count("*").alias("df")).join(by_country, "country").select("country", "t", F.log(F.col("n") / F.col("df")).alias("w"))
    known = own.join(idf, ["country", "t"], "left").select("entity_id", F.struct("t", F.coalesce("w", F.lit(UNKNOWN_IDF)).alias("w")).alias("x"))
    return known.groupBy("entity_id").agg(F.array_sort(F.collect_list("x")).alias("words"))


def _weights(q: Column, s: Column, prefix: str) -> dict[str, Column]:
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["w"])
    other = F.transform(s, lambda x: x["t"])
    hit = total(F.filter(q, lambda x: F.array_contains(other, x["t"])))
    qw, sw = total(q), total(s)
    miss = F.array_max(F.transform(F.filter(q, lambda x: ~F.array_contains(other, x["t"])), lambda x: x["w"]))
    share = lambda d: F.round(hit / F.greatest(d, F.lit(1e-6)), 6)
    return {f"{prefix}_wq": share(qw), f"{prefix}_ws": share(sw), f"{prefix}_wj": share(qw + sw - hit), f"{prefix}_hw": F.round(hit, 6), f"{prefix}_qmiss": F.round(F.coalesce(miss, F.lit(0.0)), 6)}


def _same(a: Column, b: Column) -> Column:
    """1 equal, 0 different, -1 unknown."""
    unknown = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(unknown, -1).otherwise((a == b).cast("int"))


def _sets() -> dict[str, Column]:
    distinct = lambda c: F.array_distinct(F.filter(c, lambda w: w != ""))
    out: dict[str, Column] = {}
    for k, column in (("n", "name_core"), ("a", "addr_words"), ("m", "addr_numbers")):
        q, s = distinct(f"q_{column}"), distinct(f"s_{column}")
        nq, ns, both = F.size(q), F.size(s), F.size(F.array_intersect(q, s))
        out |= {f"q{k}_len": nq, f"s{k}_len": ns, f"{k}_inter": both}
        if k != "m":
            out[f"{k}_jac"] = F.round(both / F.greatest(nq + ns - both, F.lit(1)), 6)
        out[f"{k}_cont"] = F.round(both / F.greatest(F.least(nq, ns), F.lit(1)), 6)
    first = lambda c: F.get(c, F.lit(0))
    out |= {"num1_eq": _same(first("q_addr_numbers"), first("s_addr_numbers")), "state_eq": _same(F.col("q_state"), F.col("s_state")), "pin_eq": _same(F.col("q_pin"), F.col("s_pin")), "first_tok_eq": _same(first("q_name_core"), first("s_name_core"))}
    ql, sl = (F.array_sort(F.filter(distinct(c), lambda w: w.isin(*LEGAL))) for c in ("q_name_full", "s_name_full"))
    out["legal_eq"] = F.when((F.size(ql) == 0) | (F.size(sl) == 0), -1).when(ql == sl, 1).when(F.arrays_overlap(ql, sl), 2).otherwise(0)
    return out


def _fuzzy() -> Column:
    said = lambda p, c, by=" ": F.array_join(f"{p}_{c}", by)
    last = lambda p: F.coalesce(F.try_element_at(F.col(f"{p}_city"), F.lit(-1)), F.lit(""))
    core, full, addr, tight, city = ((said("q", c, by), said("s", c, by)) for c, by in (("name_core", " "), ("name_full", " "), ("addr_words", " "), ("name_core", ""), ("city", " ")))
    return text.similarities({
        "n_ratio": ("ratio", *core), "n_tsort": ("token_sort_ratio", *core), "n_tset": ("token_set_ratio", *core), "n_partial": ("partial_ratio", *core),
        "nf_tsort": ("token_sort_ratio", *full), "nf_tset": ("token_set_ratio", *full), "cc_ratio": ("ratio", *tight), "cc_partial": ("partial_ratio", *tight), "cc_jw": ("jaro_winkler", *tight),
        "alt_tset": ("token_set_ratio", said("q", "name_alt"), core[1]), "a_ratio": ("ratio", *addr), "a_tsort": ("token_sort_ratio", *addr), "a_tset": ("token_set_ratio", *addr), "a_partial": ("partial_ratio", *addr),
        "city_tset": ("token_set_ratio", *city), "city_last": ("ratio", last("q"), last("s")),
    })


FUZZY = ("n_ratio", "n_tsort", "n_tset", "n_partial", "nf_tsort", "nf_tset", "cc_ratio", "cc_partial", "cc_jw", "alt_tset", "a_ratio", "a_tsort", "a_tset", "a_partial", "city_tset", "city_last")


def record_features(pairs: DataFrame, records: DataFrame, fuzzy: bool = True) -> DataFrame:
    """pairs (rid, s1, bscore, nkeys, brank) of scored_candidates, those below LEAST_SHARE of a target's best score left out,
    with the set, equality, weight and context features; with `fuzzy` also the scorers' (0 to 100; alt_tset is -1 without
    an alias, cc_jw 0 to 1). Missing texts count as empty, equality with a missing side is -1,
    brel is null where the best score is 0. Ranks give ties the greatest rank
    (n_tset_rank, a_tset_rank, w_sum_rank) or the least one (brank_min)."""
    by = Window.partitionBy("rid")
    rows = pairs.withColumn("btop", F.max("bscore").over(by)).filter(F.col("bscore") >= LEAST_SHARE * F.col("btop"))
    none = F.array().cast("array<string>")
    filled = records.select("entity_id", *(F.coalesce(c, none).alias(c) for c in LISTS), "state", "pin", *FLAGS)
    weights = {k: weighted_words(records, c) for k, c in (("wn", "name_core"), ("wa", "addr_words"))}
    empty = F.array().cast("array<struct<t:string,w:double>>")
    for k, w in weights.items():
        filled = filled.join(w.withColumnRenamed("words", k), "entity_id", "left").withColumn(k, F.coalesce(k, empty))
    sides = [filled.select(*(F.col(c).alias(f"{p}_{c}") for c in filled.columns)) for p in ("q", "s")]
    rows = rows.join(sides[0], F.col("rid") == F.col("q_entity_id")).join(sides[1], F.col("s1") == F.col("s_entity_id"))
    out = {
        "brel": F.round(F.try_divide("bscore", "btop"), 6), **{f: F.col(f"q_{f}").cast("int") for f in FLAGS}, "q_addr_empty": (F.size("q_addr_words") == 0).cast("int"),
        "qn_chars": F.char_length(F.array_join("q_name_core", " ")), "sn_chars": F.char_length(F.array_join("s_name_core", " ")),
        **_sets(), **_weights(F.col("q_wn"), F.col("s_wn"), "wn"), **_weights(F.col("q_wa"), F.col("s_wa"), "wa"),
    }
    if fuzzy:
        rows = rows.withColumn("__f", _fuzzy())
        out |= {n: F.round(F.col("__f")[n], 4) for n in FUZZY} | {"alt_tset": F.when(F.size("q_name_alt") == 0, -1.0).otherwise(F.round(F.col("__f.alt_tset"), 4))}
    rows = rows.select("rid", "s1", "bscore", "nkeys", "brank", "btop", *(c.alias(n) for n, c in out.items()))
    rows = rows.withColumn("w_sum", F.round(F.col("wn_wj") + F.col("wa_wj"), 6))
    most = lambda c: F.count("*").over(by.orderBy(F.desc(c)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"q_ncand": F.count("*").over(by), "w_sum_rank": most("w_sum"), "w_sum_gap": F.round(F.col("w_sum") - F.max("w_sum").over(by), 6), "brank_min": F.rank().over(by.orderBy(F.desc("bscore"))).cast("long"), "n_top_ties": F.count_if(F.col("bscore") == F.col("btop")).over(by)})
    return rows.withColumns({f"{c}_rank": most(c) for c in ("n_tset", "a_tset")}) if fuzzy else rows


def features_sql() -> str:
    """Without fuzzy scores: rec from norm, feat2 from scored and rec."""
    d = lambda c: f"list_distinct(list_filter({c}, lambda w: w <> ''))"
    tri = lambda a, b: f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN -1 WHEN {a} = {b} THEN 1 ELSE 0 END"
    sets = []
    for k, c in (("n", "core"), ("a", "addr"), ("m", "nums")):
        q, s = f"q.{c}", f"s.{c}"
        both = f"length(list_intersect({d(q)}, {d(s)}))"
        nq, ns = f"length({d(q)})", f"length({d(s)})"
        sets += [f"{nq} AS q{k}_len", f"{ns} AS s{k}_len", f"{both} AS {k}_inter", f"round({both} / greatest(least({nq}, {ns}), 1)::DOUBLE, 6) AS {k}_cont"]
        if k != "m":
            sets.append(f"round({both} / greatest({nq} + {ns} - {both}, 1)::DOUBLE, 6) AS {k}_jac")
    legal = lambda p: f"list_sort(list_filter({d(p + '.full_')}, lambda w: w IN ({', '.join(repr(w) for w in LEGAL)})))"
    sets += [f"{tri('q.nums[1]', 's.nums[1]')} AS num1_eq", f"{tri('q.state', 's.state')} AS state_eq", f"{tri('q.pin', 's.pin')} AS pin_eq", f"{tri('q.core[1]', 's.core[1]')} AS first_tok_eq",
             f"CASE WHEN length({legal('q')}) = 0 OR length({legal('s')}) = 0 THEN -1 WHEN {legal('q')} = {legal('s')} THEN 1 WHEN list_has_any({legal('q')}, {legal('s')}) THEN 2 ELSE 0 END AS legal_eq"]
    sets += ["0 AS is_domain", "0 AS is_dba", "0 AS is_native", "(length(q.addr) = 0)::INT AS q_addr_empty", "length(array_to_string(q.core, ' ')) AS qn_chars", "length(array_to_string(s.core, ' ')) AS sn_chars"]

    def weights(p: str, c: str) -> str:
        return f"""{p}o AS (SELECT DISTINCT entity_id, country, unnest({c}) AS t FROM rec), {p}i AS (SELECT country, t, ln(any_value(n) / count(*)::DOUBLE) AS w FROM {p}o JOIN land2 USING (country) GROUP BY country, t),
{p}w AS (SELECT entity_id, t, coalesce(w, {UNKNOWN_IDF}) AS w FROM {p}o LEFT JOIN {p}i USING (country, t) WHERE t <> ''), {p}t AS (SELECT entity_id, sum(w) AS w FROM {p}w GROUP BY 1),
{p}q AS (SELECT rid, s1, sum(CASE WHEN b.t IS NOT NULL THEN a.w ELSE 0 END) AS h, max(CASE WHEN b.t IS NULL THEN a.w END) AS m FROM kept2 JOIN {p}w a ON a.entity_id = rid LEFT JOIN {p}w b ON b.entity_id = s1 AND b.t = a.t GROUP BY 1, 2)"""

    def shares(p: str) -> str:
        h, q, s = f"coalesce({p}q.h, 0)", f"coalesce({p}x.w, 0)", f"coalesce({p}y.w, 0)"
        return f"round({h} / greatest({q}, 1e-6), 6) AS {p}_wq, round({h} / greatest({s}, 1e-6), 6) AS {p}_ws, round({h} / greatest({q} + {s} - {h}, 1e-6), 6) AS {p}_wj, round({h}::DOUBLE, 6) AS {p}_hw, round(coalesce({p}q.m, 0)::DOUBLE, 6) AS {p}_qmiss"

    joins = " ".join(f"LEFT JOIN {p}q ON {p}q.rid = k.rid AND {p}q.s1 = k.s1 LEFT JOIN {p}t {p}x ON {p}x.entity_id = k.rid LEFT JOIN {p}t {p}y ON {p}y.entity_id = k.s1" for p in ("wn", "wa"))
    return f"""rec AS (SELECT norm.entity_id, norm.country, string_split(coalesce(n_name, ''), ' ') AS full_, core, addr, addr_nums AS nums, coalesce(addr[-1], '') AS state, pin FROM norm JOIN kw USING (entity_id)),
land2 AS (SELECT country, count(*) AS n FROM rec GROUP BY 1), kept2 AS (SELECT * FROM (SELECT *, max(bscore) OVER (PARTITION BY rid) AS btop FROM scored) WHERE bscore >= {LEAST_SHARE} * btop),
{weights('wn', 'core')}, {weights('wa', 'addr')},
feat1 AS (SELECT k.*, round(bscore / nullif(btop, 0), 6) AS brel, {', '.join(sets)}, {shares('wn')}, {shares('wa')} FROM kept2 k JOIN rec q ON q.entity_id = k.rid JOIN rec s ON s.entity_id = k.s1 {joins}),
feat2 AS (SELECT *, count(*) OVER (PARTITION BY rid) AS q_ncand, count(*) OVER (PARTITION BY rid ORDER BY w_sum DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w_sum_rank, round(w_sum - max(w_sum) OVER (PARTITION BY rid), 6) AS w_sum_gap,
rank() OVER (PARTITION BY rid ORDER BY bscore DESC) AS brank_min, count(CASE WHEN bscore = btop THEN 1 END) OVER (PARTITION BY rid) AS n_top_ties FROM (SELECT *, round(wn_wj + wa_wj, 6) AS w_sum FROM feat1))"""
