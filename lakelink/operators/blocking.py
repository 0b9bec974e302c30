"""Candidate pairs by blocking channels (B1-B5) and by scored keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .normalize import LEGAL_WORDS, core_tokens, tokens

# The caps of candidates and of a rare word below the channels.
EXACT = [(1, "n_name"), (2, "n_sorted"), (3, "n_core_sorted"), (4, "n_addr"), (5, "a_sorted")]
RARE = [(6, "name", "name_tokens"), (7, "addr", "addr_tokens")]
MAX_CANDIDATES, MAX_TOKEN_DF = 10, 5000


def sides(norm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source 1 and the targets (sources 2 and 3)."""
    return norm.filter(F.col("entity_id").startswith("S1-")), norm.filter(~F.col("entity_id").startswith("S1-"))


def token_postings(targets: DataFrame, max_df: int = MAX_TOKEN_DF) -> DataFrame:
    """(kind, token, entity_id, country, df) of tokens that at most max_df entities hold."""
    each = [targets.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(col)).alias("token"), "entity_id", "country") for _, kind, col in RARE]
    rows = each[0].unionAll(each[1])
    df = rows.groupBy("kind", "token").agg(F.count("*").alias("df")).filter(F.col("df") <= max_df)
    return rows.join(df, ["kind", "token"])


def least(targets: DataFrame, keys: list[str], first: int | None) -> DataFrame:
    """The first targets of each key: a cap of as many within a channel never reaches beyond them."""
    if first is None:
        return targets
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("tid"))
    return targets.withColumn("rn", rank).filter(F.col("rn") <= first).drop("rn")


def channel_pairs(norm: DataFrame, max_df: int = MAX_TOKEN_DF, first: int | None = None) -> DataFrame:
    """(sid, tid, prio) of all channels, each pair once in each channel; with `first`, only what a cap of
    as many targets within a channel can keep."""
    s1, targets = sides(norm)
    out = []
    for prio, key in EXACT:
        left = s1.filter(F.col(key).isNotNull()).select(F.col("entity_id").alias("sid"), "country", F.col(key).alias("k"))
        right = targets.filter(F.col(key).isNotNull()).select(F.col("entity_id").alias("tid"), "country", F.col(key).alias("k"))
        right = least(right, ["country", "k"], first)
        out.append(left.join(right, ["country", "k"]).select("sid", "tid", F.lit(prio).alias("prio")))
    postings = token_postings(targets, max_df)
    for prio, kind, col in RARE:
        left = s1.select(F.col("entity_id").alias("sid"), "country", F.explode(F.array_distinct(col)).alias("token"))
        right = least(postings.filter(F.col("kind") == kind).select(F.col("entity_id").alias("tid"), "country", "token"), ["country", "token"], first)
        out.append(left.join(right, ["country", "token"]).select("sid", "tid", F.lit(prio).alias("prio")).distinct())
    return reduce(DataFrame.unionAll, out)


def channel_volume(norm: DataFrame, max_df: int = MAX_TOKEN_DF) -> DataFrame:
    """(prio, n_raw) of the channels that make any pair. Pairs of the exact keys are counted as products of group sizes;
    those of the rare words are listed once each, at most max_df a word."""
    s1, targets = sides(norm)
    is_s1 = F.col("entity_id").startswith("S1-")
    out = []
    for prio, key in EXACT:
        groups = norm.filter(F.col(key).isNotNull()).groupBy("country", key).agg(F.count_if(is_s1).alias("a"), F.count_if(~is_s1).alias("b"))
        out.append(groups.filter("a > 0 AND b > 0 AND country IS NOT NULL").groupBy(F.lit(prio).alias("prio")).agg(F.sum(F.col("a") * F.col("b")).alias("n_raw")))
    postings = token_postings(targets, max_df)
    for prio, kind, col in RARE:
        left = s1.select(F.col("entity_id").alias("sid"), "country", F.explode(F.array_distinct(col)).alias("token"))
        right = postings.filter(F.col("kind") == kind).select(F.col("entity_id").alias("tid"), "country", "token")
        out.append(left.join(right, ["country", "token"]).select("sid", "tid").distinct().groupBy(F.lit(prio).alias("prio")).agg(F.count("*").alias("n_raw")))
    return reduce(DataFrame.unionAll, out)


def candidates(pairs: DataFrame, cap: int = MAX_CANDIDATES) -> DataFrame:
    """At most cap targets of each sid: first within each channel, then by the best channel over all."""
    per = Window.partitionBy("sid", "prio").orderBy("tid")
    few = pairs.withColumn("rn", F.row_number().over(per)).filter(F.col("rn") <= cap)
    best = few.groupBy("sid", "tid").agg(F.min("prio").alias("prio"))
    rank = Window.partitionBy("sid").orderBy("prio", "tid")
    return best.withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= cap).select("sid", "tid", "prio")


def _channel_sql(prio: int, key: str) -> str:
    return f"SELECT a.entity_id AS sid, b.entity_id AS tid, {prio} AS prio FROM s1 a JOIN tg b ON a.country = b.country AND a.{key} = b.{key}"


def _token_sql(prio: int, kind: str, col: str) -> str:
    return f"""SELECT DISTINCT a.sid, p.entity_id AS tid, {prio} AS prio FROM (SELECT entity_id AS sid, country, unnest(list_distinct({col})) AS token FROM s1) a
  JOIN postings p ON p.kind = '{kind}' AND p.token = a.token AND p.country = a.country"""


SIDES_SQL = "s1 AS (SELECT * FROM norm WHERE entity_id LIKE 'S1-%'), tg AS (SELECT * FROM norm WHERE entity_id NOT LIKE 'S1-%')"
POSTINGS_SQL = f"""posted AS (SELECT 'name' AS kind, unnest(list_distinct(name_tokens)) AS token, entity_id, country FROM tg UNION ALL SELECT 'addr', unnest(list_distinct(addr_tokens)), entity_id, country FROM tg),
postings AS (SELECT p.kind, p.token, entity_id, country, df FROM posted p JOIN (SELECT kind, token, count(*) AS df FROM posted GROUP BY ALL HAVING count(*) <= {MAX_TOKEN_DF}) d ON p.kind = d.kind AND p.token = d.token)"""
PAIRS_SQL = "pairs AS (" + " UNION ALL ".join([_channel_sql(*c) for c in EXACT] + [_token_sql(*c) for c in RARE]) + ")"


def candidates_sql(cap: int = MAX_CANDIDATES) -> str:
    return f"""kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, prio ORDER BY tid) AS rn FROM pairs) WHERE rn <= {cap}),
best AS (SELECT sid, tid, min(prio) AS prio FROM kept GROUP BY sid, tid),
cand AS (SELECT sid, tid, prio FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY prio, tid) AS rn FROM best) WHERE rn <= {cap})"""


# Scored keys: kind 0 name word or prefix x address word or postal code, 1 pair of name words, 2 number x address word or
# pair of address words, 3 whole sorted core name, 4 name word or prefix.
# Most Source 1 records of a key by kind, of any key, and how many words of a record make keys.
CAPS = {0: 50, 1: 50, 2: 30, 3: 50, 4: 20}
CAPS_WITHOUT_ADDRESS = {0: 50, 1: 300, 2: 30, 3: 300, 4: 300}
MOST_DF = 300
NAME_WORDS, NUMBERS, ADDRESS_WORDS, PAIRED_WORDS = 4, 3, 9, 4
# Address words that say nothing.
GENERIC = (
    "st", "rd", "ave", "dr", "blvd", "ln", "ct", "pl", "sq", "hwy", "pkwy", "cir", "ter", "trl", "ste", "apt", "fl", "bldg", "unit", "po", "box", "rue", "near", "opposite", "main", "cross",
    "ground", "and", "des", "the", "city", "way", "floor", "nagar", "road", "sector", "phase", "complex", "colony", "indl", "estate", "dist", "vill", "apts", "chemin", "allee", "impasse",
    "lane", "street", "off", "wing", "block", "office", "tower", "plaza", "pvt", "ltd", "1st", "2nd", "3rd", "4th", "5th",
)


def key_records(norm: DataFrame) -> DataFrame:
    """What the scored keys read, from normalised records: words in their order, no alias; a six-digit number of the address is
    the postal code. Parsed records (records.parsed_names, parsed_addresses) have these columns of their own."""
    pin = F.coalesce(F.try_element_at(F.filter("addr_nums", lambda n: F.length(n) == 6), F.lit(-1)), F.lit(""))
    return norm.select("entity_id", "country", core_tokens(tokens(F.col("n_name"))).alias("name_core"), F.array().cast("array<string>").alias("name_alt"), tokens(F.col("n_addr")).alias("addr_words"), pin.alias("pin"))


def scored_keys(records: DataFrame) -> DataFrame:
    """(entity_id, country, no_address, kind, k): the keys of each record, each once, scoped by country. Nulls count as empty."""
    none = F.array().cast("array<string>")
    core, alt, addr = (F.filter(F.coalesce(c, none), lambda w: w != "") for c in ("name_core", "name_alt", "addr_words"))
    joined = F.array_join(core, "")
    start = lambda w: F.concat(F.lit("~"), F.left(w, F.lit(6)))
    rows = records.select(
        "entity_id", "country", F.array_join(F.array_sort(core), " ").alias("full"), (F.size(addr) == 0).alias("no_address"),
        F.slice(F.array_distinct(F.filter(F.concat(core, alt), lambda w: F.length(w) >= 2)), 1, NAME_WORDS).alias("n"),
        F.array_distinct(F.concat(F.when(F.length(joined) >= 6, F.array(start(joined))).otherwise(none), F.transform(F.filter(core, lambda w: F.length(w) >= 8), start))).alias("starts"),
        F.array_distinct(F.filter(addr, lambda w: ~w.isin(*GENERIC))).alias("a"), F.when(F.col("pin") != "", F.array(F.concat(F.lit("pin"), "pin"))).otherwise(none).alias("pin"),
    )
    words = F.filter("a", lambda w: ~w.rlike("^[0-9]+$") & (F.length(w) >= 3))
    longest = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))))
    rows = rows.withColumn("nums", F.slice(F.filter("a", lambda w: w.rlike("^[0-9]+$")), 1, NUMBERS)).withColumn("words", F.slice(F.transform(longest, lambda s: s["w"]), 1, ADDRESS_WORDS))
    rows = rows.withColumn("t", F.concat("n", "starts")).withColumn("four", F.slice("words", 1, PAIRED_WORDS))
    tag = lambda kind, parts: F.struct(F.lit(kind).alias("kind"), F.concat_ws("|", *parts).alias("k"))
    cross = lambda kind, xs, ys: F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: tag(kind, [x, y]))))
    pairs = lambda kind, xs: F.flatten(F.transform(xs, lambda x: F.transform(F.filter(xs, lambda y: x < y), lambda y: tag(kind, [x, y]))))
    whole = F.filter(F.array(tag(3, [F.col("full")])), lambda s: F.col("full") != "")
    keys = F.concat(cross(0, F.col("t"), F.concat("nums", "words", "pin")), pairs(1, F.col("n")), cross(2, F.col("nums"), F.col("words")), pairs(2, F.col("four")), whole, F.transform("t", lambda x: tag(4, [x])))
    return rows.select("entity_id", "country", "no_address", F.explode(F.array_distinct(keys)).alias("s")).select("entity_id", "country", "no_address", "s.kind", "s.k")


def key_index(keys: DataFrame, s1: DataFrame) -> DataFrame:
    """Keys of Source 1 with their frequency and weight ln(N / df), N being the records of the country; keys of more than
    MOST_DF entities go (the reference's rule for keys that select nothing)."""
    n = s1.groupBy("country").agg(F.count("*").cast("double").alias("n"))
    df = keys.groupBy("country", "kind", "k").agg(F.count("*").alias("df")).filter(F.col("df") <= MOST_DF)
    df = df.join(n, "country").withColumn("w", F.log("n") - F.log(F.col("df").cast("double"))).drop("n")
    return keys.select("country", "kind", "k", F.col("entity_id").alias("s1")).join(df, ["country", "kind", "k"])


def scored_candidates(records: DataFrame, top: int = 20, relative: float = 0.2) -> DataFrame:
    """(rid, s1, bscore, nkeys, brank): for each target its best Source 1 records by summed key weights."""
    s1, targets = sides(records)
    return scored_against(targets, key_index(scored_keys(s1), s1), top, relative)


def scored_against(targets: DataFrame, index: DataFrame, top: int = 20, relative: float = 0.2) -> DataFrame:
    """scored_candidates of target records on an index of Source 1 that is already there."""
    cap = lambda caps: F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("kind"))
    hits = scored_keys(targets).withColumnRenamed("entity_id", "rid").join(index, ["country", "kind", "k"])
    hits = hits.filter(F.col("df") <= F.when(F.col("no_address"), cap(CAPS_WITHOUT_ADDRESS)).otherwise(cap(CAPS)))
    scores = hits.groupBy("rid", "s1").agg(F.round(F.sum("w"), 6).alias("bscore"), F.count("*").alias("nkeys"))
    by = Window.partitionBy("rid")
    scores = scores.withColumn("brank", F.row_number().over(by.orderBy(F.desc("bscore"), "s1")).cast("long")).withColumn("btop", F.max("bscore").over(by))
    return scores.filter((F.col("brank") <= top) & (F.col("bscore") >= relative * F.col("btop"))).select("rid", "s1", "bscore", "nkeys", "brank")


def _cap_sql(caps: dict) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {v}" for k, v in caps.items()) + " END"


KEY_RECORDS_SQL = f"""kw AS (SELECT entity_id, country, list_filter(CASE WHEN n_name IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(n_name, ' ') END, lambda w: length(w) >= 2 AND w NOT IN ({", ".join(f"'{w}'" for w in LEGAL_WORDS)})) AS core, CAST([] AS VARCHAR[]) AS alt,
  CASE WHEN n_addr IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(n_addr, ' ') END AS addr, coalesce(list_filter(addr_nums, lambda n: length(n) = 6)[-1], '') AS pin FROM norm)"""


def scored_sql(top: int = 20, relative: float = 0.2) -> str:
    """On kw (entity_id, country, core, alt, addr, pin)."""
    seen = lambda of: f"SELECT entity_id, w, min(i) AS i FROM (SELECT entity_id, unnest({of}) AS w, generate_subscripts({of}, 1) AS i FROM kw) GROUP BY ALL"
    return f"""nu AS ({seen('list_concat(core, alt)')}), n AS (SELECT entity_id, w FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY i) AS rn FROM nu WHERE length(w) >= 2) WHERE rn <= {NAME_WORDS}),
st AS (SELECT entity_id, '~' || left(array_to_string(core, ''), 6) AS w FROM kw WHERE length(array_to_string(core, '')) >= 6 UNION SELECT entity_id, '~' || left(w, 6) FROM (SELECT entity_id, unnest(core) AS w FROM kw) WHERE length(w) >= 8),
t AS (SELECT * FROM n UNION ALL SELECT * FROM st), au AS (SELECT * FROM ({seen('addr')}) WHERE w NOT IN ({", ".join(f"'{w}'" for w in GENERIC)})),
nums AS (SELECT entity_id, w FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY i) AS rn FROM au WHERE regexp_full_match(w, '[0-9]+')) WHERE rn <= {NUMBERS}),
alph AS (SELECT entity_id, w, rn FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY length(w) DESC, i) AS rn FROM au WHERE NOT regexp_full_match(w, '[0-9]+') AND length(w) >= 3) WHERE rn <= {ADDRESS_WORDS}),
ks AS (SELECT t.entity_id, 0 AS kind, t.w || '|' || a.w AS k FROM t JOIN (SELECT * FROM nums UNION ALL SELECT entity_id, w FROM alph UNION ALL SELECT entity_id, 'pin' || pin FROM kw WHERE pin <> '') a ON a.entity_id = t.entity_id
  UNION SELECT x.entity_id, 1, x.w || '|' || y.w FROM n x JOIN n y ON x.entity_id = y.entity_id AND x.w < y.w
  UNION SELECT x.entity_id, 2, x.w || '|' || y.w FROM nums x JOIN alph y ON x.entity_id = y.entity_id
  UNION SELECT x.entity_id, 2, x.w || '|' || y.w FROM alph x JOIN alph y ON x.entity_id = y.entity_id AND x.w < y.w AND x.rn <= {PAIRED_WORDS} AND y.rn <= {PAIRED_WORDS}
  UNION SELECT entity_id, 3, array_to_string(list_sort(core), ' ') FROM kw WHERE length(core) > 0 UNION SELECT entity_id, 4, w FROM t),
keyed AS (SELECT ks.*, country, length(addr) = 0 AS no_address FROM ks JOIN kw USING (entity_id)),
k1 AS (SELECT * FROM keyed WHERE entity_id LIKE 'S1-%'), land AS (SELECT country, count(*)::DOUBLE AS n FROM kw WHERE entity_id LIKE 'S1-%' GROUP BY 1),
dfs AS (SELECT country, kind, k, df, ln(n) - ln(df::DOUBLE) AS w FROM (SELECT country, kind, k, count(*) AS df FROM k1 GROUP BY ALL HAVING count(*) <= {MOST_DF}) JOIN land USING (country)),
hits AS (SELECT q.entity_id AS rid, k1.entity_id AS s1, d.w FROM keyed q JOIN dfs d ON q.country = d.country AND q.kind = d.kind AND q.k = d.k JOIN k1 ON k1.country = d.country AND k1.kind = d.kind AND k1.k = d.k
  WHERE q.entity_id NOT LIKE 'S1-%' AND d.df <= CASE WHEN q.no_address THEN {_cap_sql(CAPS_WITHOUT_ADDRESS).replace('CASE kind', 'CASE q.kind')} ELSE {_cap_sql(CAPS).replace('CASE kind', 'CASE q.kind')} END),
sc AS (SELECT rid, s1, round(sum(w), 6) AS bscore, count(*) AS nkeys FROM hits GROUP BY rid, s1),
rk AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY bscore DESC, s1) AS brank, max(bscore) OVER (PARTITION BY rid) AS btop FROM sc),
scored AS (SELECT rid, s1, bscore, nkeys, brank FROM rk WHERE brank <= {top} AND bscore >= {relative} * btop)"""
