"""Queries of the audits, parsers and removal gates, with the SQL that must give the same rows. Importing it registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import JACCARD_SQL, WD, WP, W, _cand, _gold, _jaccard, _norm, query
from .functions.scripts import transliterated
from .operators import audits, blocking, evidence, gates, record_features, records
from .operators.normalize import LEET_FROM, LEET_TO, ORDINAL, unleet
from .sources import adapters

_LINKS = "g1 AS (SELECT DISTINCT sid, tid FROM gold)"
_DICTS = records.Dictionaries(name={"limited": "ltd", "company": "co", "corporation": "corp"}, states={"": {"france": "fr", "germany": "de", "united states": "us"}}, address={"": {"automobile": "auto", "household": "home", "the": ""}})


@query(f"""{W}, {JACCARD_SQL}, {_LINKS}, c AS (SELECT count_if(coalesce(score >= 0.5, false) AND g1.sid IS NOT NULL) AS tp, count_if(coalesce(score >= 0.5, false)) AS n_pred, count(g1.sid) AS n_gold FROM sp FULL JOIN g1 ON sp.sid = g1.sid AND sp.tid = g1.tid)
SELECT tp, n_pred, n_gold, round(coalesce(tp / nullif(n_pred, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(n_gold, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(n_pred + n_gold, 0)::DOUBLE, 0), 6) AS f1, round(coalesce(5 * tp / nullif(4 * n_pred + n_gold, 0)::DOUBLE, 0), 6) AS f05 FROM c""")
def micro_scores(spark, sf_dir):
    return audits.micro_scores(_jaccard(spark, sf_dir), _gold(spark, sf_dir), 0.5)


@query(f"""{W}, {JACCARD_SQL}, {_LINKS}, st AS (SELECT score, count(*) AS n, count(g1.sid) AS t FROM sp LEFT JOIN g1 USING (sid, tid) GROUP BY 1), rn AS (SELECT t, sum(t) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC)::DOUBLE AS p FROM st)
SELECT (SELECT count(*) FROM g1) AS n_gold, round(coalesce(sum(t * p) / nullif((SELECT count(*) FROM g1), 0), 0), 6) AS ap FROM rn""")
def average_precision(spark, sf_dir):
    return audits.average_precision(_jaccard(spark, sf_dir), _gold(spark, sf_dir))


@query(f"{W}, f AS (SELECT entity_id, count(tid) AS n FROM s1 LEFT JOIN cand ON sid = entity_id GROUP BY 1) SELECT count(*) AS n_entities, count_if(n = 0) AS n_without, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most FROM f")
def retrieval_stats(spark, sf_dir):
    norm = _norm(spark, sf_dir)
    return audits.retrieval_stats(blocking.sides(norm)[0], _cand(spark, sf_dir, norm))


@query(f"{WD} SELECT substr(entity_id, 1, 2) AS source, count(*) AS n, count(DISTINCT entity_id) AS n_ids, count(entity_id) - count(DISTINCT entity_id) AS n_repeated, count_if(coalesce(trim(business_name), '') = '') AS blank_names, count_if(coalesce(trim(business_address), '') = '') AS blank_addresses, count_if(coalesce(trim(country), '') = '') AS blank_countries FROM src GROUP BY 1")
def id_diagnostics(spark, sf_dir):
    return audits.id_diagnostics(adapters.docs(spark, sf_dir))


@query(f"{W}, {_LINKS} SELECT a.country, b.country AS target_country, count(*) AS n, " + ", ".join(f"round(avg((left(a.n_name, {k}) = left(b.n_name, {k}))::INT), 6) AS p{k}" for k in (1, 2, 3, 4, 6, 8, 10)) + " FROM g1 JOIN norm a ON a.entity_id = sid JOIN norm b ON b.entity_id = tid GROUP BY ALL")
def prefix_agreement(spark, sf_dir):
    return audits.prefix_agreement(_gold(spark, sf_dir), _norm(spark, sf_dir))


@query(f"""{W}, {_LINKS}, gr AS (SELECT country, n_name, count_if(entity_id LIKE 'S1-%') AS a, count_if(entity_id NOT LIKE 'S1-%') AS b FROM norm WHERE n_name IS NOT NULL GROUP BY ALL), vol AS (SELECT country, sum(a * b)::BIGINT AS n_pairs, max(a * b) AS largest FROM gr GROUP BY 1),
fo AS (SELECT a.country, count(*) AS n FROM g1 JOIN norm a ON a.entity_id = sid JOIN norm b ON b.entity_id = tid WHERE a.country = b.country AND a.n_name = b.n_name GROUP BY 1) SELECT country, n_pairs, largest, coalesce(n, 0) AS n_found FROM vol LEFT JOIN fo USING (country)""")
def exact_name_audit(spark, sf_dir):
    return audits.exact_name_audit(_norm(spark, sf_dir), _gold(spark, sf_dir))


@query(f"{W}, {JACCARD_SQL}, {_LINKS} SELECT country, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90 FROM sp JOIN g1 USING (sid, tid) JOIN norm ON entity_id = sid GROUP BY 1")
def similarity_profile(spark, sf_dir):
    return audits.similarity_profile(_jaccard(spark, sf_dir), _gold(spark, sf_dir), _norm(spark, sf_dir))


@query(f"{W} SELECT country, regexp_replace(coalesce(business_address, ''), '[0-9]+', '#', 'g') AS shape, count(*) AS n, count(DISTINCT business_address) AS n_texts, count(DISTINCT try_cast(nullif(regexp_extract(business_address, '(?:^|[\\s,#])0*(\\d{{1,6}})(?:[A-Za-z]?\\b|[-/ ])', 1), '') AS BIGINT)) AS n_numbers FROM src GROUP BY ALL")
def address_shapes(spark, sf_dir):
    return audits.address_shapes(adapters.parts(spark, sf_dir))


_UNLEET = f"CASE WHEN regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '{ORDINAL}') THEN translate(w, '{LEET_FROM}', '{LEET_TO}') ELSE w END"


@query(f"WITH x AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT w AS word, {_UNLEET} AS rewritten, count(*) AS n FROM x GROUP BY ALL) SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rewritten) AS n_merged FROM c) WHERE word <> rewritten")
def token_rewrites(spark, sf_dir):
    words = adapters.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    return audits.token_rewrites(words.select("w", unleet(F.col("w")).alias("after")), "w", "after")


_HOLLOW = ("null", "n/a", "na", "none", "building")


@query(f"""{WP}, p AS (SELECT country, list_transform(string_split(lower(coalesce(business_address, '')), ','), lambda x: trim(x)) AS ps FROM src), k AS (SELECT country, length(ps) AS n, length(list_filter(ps, lambda x: x IN {_HOLLOW})) AS h, length(list_filter(ps, lambda x: x = '')) AS e FROM p)
SELECT country, count(*) AS n, count_if(h + e = k.n) AS n_hollow, count_if(h > 0) AS n_component, count_if(h > 0 AND h + e < k.n) AS n_usable FROM k GROUP BY 1""")
def placeholder_audit(spark, sf_dir):
    return audits.placeholder_audit(adapters.people(spark, sf_dir), "business_address", _HOLLOW)


_KEYS_SQL = """kx AS (SELECT entity_id, unnest([{'f': 'name_exact', 'k': n_name}, {'f': 'toksort', 'k': n_sorted}, {'f': 'prefix6', 'k': left(n_name, 6)}, {'f': 'char3', 'k': left(n_name, 3)},
{'f': 'rare_tok', 'k': list_sort(list_transform(name_tokens, lambda w: {'n': -length(w), 'w': w}))[1].w}, {'f': 'place', 'k': string_split(coalesce(n_addr, ''), ' ')[-1]},
{'f': 'housenum_place', 'k': CASE WHEN regexp_extract(coalesce(n_addr, ''), '^([0-9]+)', 1) <> '' THEN regexp_extract(n_addr, '^([0-9]+)', 1) || '|' || string_split(n_addr, ' ')[-1] END}]) AS s FROM norm), ks AS (SELECT entity_id, s.f AS family, s.k AS key FROM kx WHERE coalesce(s.k, '') <> '')"""


@query(f"{W}, {_KEYS_SQL} SELECT entity_id, family, key FROM ks")
def audit_keys(spark, sf_dir):
    return audits.audit_keys(_norm(spark, sf_dir))


@query(f"{W}, {_KEYS_SQL} SELECT entity_id, family, key FROM (SELECT *, row_number() OVER (PARTITION BY family, key ORDER BY md5(family || ':' || entity_id || ':' || key), entity_id) AS rn FROM ks) WHERE rn <= 3")
def posting_sample(spark, sf_dir):
    return audits.posting_sample(audits.audit_keys(_norm(spark, sf_dir)), 3)


_GRAMS_SQL = f"lf AS (SELECT entity_id, coalesce(n_name, '') AS name, coalesce(n_addr, '') AS second FROM s1), rt AS (SELECT entity_id, coalesce(n_name, '') AS name, coalesce(n_addr, '') AS second FROM tg), {evidence.evidence_sql('parts')}"


def _evidence(spark, sf_dir, fuzzy: bool) -> DataFrame:
    sides = (x.select("entity_id", F.col("n_name").alias("name"), F.col("n_addr").alias("second")) for x in blocking.sides(_norm(spark, sf_dir)))
    return evidence.evidence_candidates(*sides, "parts", fuzzy=fuzzy)


@query(f"{W}, {_GRAMS_SQL} SELECT sid, tid, n_name_word, n_gram, n_second_word, evidence, score, rank FROM gq")
def evidence_candidates(spark, sf_dir):
    return _evidence(spark, sf_dir, False)


@query()
def gram_candidates(spark, sf_dir):
    """The candidates re-ranked by fuzzy scores, which SQL lacks (tested against a plain version)."""
    return _evidence(spark, sf_dir, True)


@query(f"""{W}, {_GRAMS_SQL}, r1 AS (SELECT sid, tid, n_gram, row_number() OVER (PARTITION BY sid ORDER BY evidence DESC, tid) AS r1 FROM gq), r2 AS (SELECT *, row_number() OVER (PARTITION BY sid, r1 <= 5 ORDER BY n_gram DESC, tid) AS r2 FROM r1)
SELECT sid, tid, r1 AS rank, r1 <= 5 AS by_first FROM r2 WHERE r1 <= 5 OR r2 <= 3""")
def two_quotas(spark, sf_dir):
    return audits.two_quotas(_evidence(spark, sf_dir, False), "evidence", "n_gram", 5, 3)


def _record_features(spark, sf_dir, fuzzy: bool) -> DataFrame:
    norm = _norm(spark, sf_dir)
    return record_features.record_features(blocking.scored_candidates(blocking.key_records(norm)), record_features.plain_records(norm), fuzzy)


@query(f"{W}, {blocking.KEY_RECORDS_SQL}, {blocking.scored_sql()}, {record_features.features_sql()} SELECT * FROM feat2")
def record_set_features(spark, sf_dir):
    return _record_features(spark, sf_dir, False)


@query()
def record_pair_features(spark, sf_dir):
    """All features, the fuzzy ones too (the others are record_set_features; tested by a hand-made case)."""
    return _record_features(spark, sf_dir, True)


@query(f"""{W}, {_LINKS}, al AS (SELECT string_split(coalesce(a.n_addr, ''), ' ') AS x, string_split(coalesce(b.n_addr, ''), ' ') AS y FROM g1 JOIN norm a ON a.entity_id = sid JOIN norm b ON b.entity_id = tid), fl AS (SELECT unnest(x) AS word, unnest(y) AS counterpart FROM al WHERE length(x) = length(y)),
ct AS (SELECT word, counterpart, count(*) AS n FROM fl WHERE word <> '' GROUP BY ALL) SELECT word, counterpart, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, counterpart) AS rn FROM ct) WHERE rn = 1 AND n >= 2""")
def learned_words(spark, sf_dir):
    rows = _norm(spark, sf_dir).select("entity_id", F.split(F.coalesce("n_addr", F.lit("")), " ").alias("w"))
    links = _gold(spark, sf_dir).distinct()
    links = links.join(rows.select(F.col("entity_id").alias("sid"), F.col("w").alias("x")), "sid").join(rows.select(F.col("entity_id").alias("tid"), F.col("w").alias("y")), "tid")
    return records.learned_words(links, "x", "y")


def _f05_sql(tp: str, fp: str, fn: str) -> str:
    return f"CASE WHEN ({tp}) + ({fp}) + ({fn}) = 0 THEN 1.0::DOUBLE ELSE 5 * ({tp}) / (5 * ({tp}) + 4 * ({fp}) + ({fn}))::DOUBLE END"


@query(f"""WITH g AS (SELECT p_name AS grp, count(*) AS m, count_if(p_size <= 10) AS r, (count(*) % 10) / 10.0::DOUBLE AS q FROM part GROUP BY 1), j AS (SELECT *, unnest(range(0, r + 1)) AS j FROM g)
SELECT grp, m, r, round(sum(factorial(r::INT)::DOUBLE / factorial(j::INT)::DOUBLE / factorial((r - j)::INT)::DOUBLE * pow(q, j) * pow(1 - q, r - j) * ({_f05_sql("m - r", "0", "r - j")} - {_f05_sql("m - j", "j", "0")})), 6) AS gain FROM j GROUP BY ALL""")
def expected_gain(spark, sf_dir):
    g = adapters.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("grp")).agg(F.count("*").alias("m"), F.count_if(F.col("p_size") <= 10).alias("r"))
    return g.select("grp", "m", "r", F.round(gates.expected_gain(F.col("r"), (F.col("m") % 10) / 10.0, F.col("m")), 6).alias("gain"))


def _house_links(spark, sf_dir) -> DataFrame:
    """Candidate links of the parts adapter with the offset of their sizes."""
    src = adapters.parts(spark, sf_dir).select("entity_id", "business_address", "country", "business_name")
    a, b = (src.select(F.col("entity_id").alias(i), F.col("business_address").alias(f"{i}_a"), F.col("business_name").alias(f"{i}_n"), F.col("country").alias(f"{i}_c")) for i in ("sid", "tid"))
    rows = _cand(spark, sf_dir).select("sid", "tid").join(a, "sid").join(b, "tid")
    size = lambda c: F.regexp_extract(c, "^([0-9]+)", 1).try_cast("bigint")
    return rows.select(F.col("sid").alias("s1"), F.col("tid").alias("rid"), F.col("sid_c").alias("country"), (size("tid_a") - size("sid_a")).alias("d"), (F.col("sid_n") == F.col("tid_n")).alias("same_name"), F.col("tid_a").alias("address"), F.col("sid_a").alias("s1_address"))


@query(f"""{W}, d AS (SELECT b.country, regexp_extract(b.business_address, '^([0-9]+)', 1)::BIGINT - regexp_extract(a.business_address, '^([0-9]+)', 1)::BIGINT AS d, a.business_name = b.business_name AS same_name FROM cand JOIN src a ON a.entity_id = sid JOIN src b ON b.entity_id = tid),
c AS (SELECT country, same_name, count_if(d IN (3, 4, 5, 7, 9, 11, 13, 21)) AS n_plus, count_if(-d IN (3, 4, 5, 7, 9, 11, 13, 21)) AS n_minus FROM d GROUP BY ALL) SELECT *, round((n_plus - n_minus) / greatest(n_plus, 1)::DOUBLE, 6) AS q FROM c""")
def offset_symmetry(spark, sf_dir):
    return gates.symmetry(_house_links(spark, sf_dir), ["country", "same_name"])


@query()
def offset_classes(spark, sf_dir):
    """Links that go by class and expected gain (tested against a plain version)."""
    links = _house_links(spark, sf_dir)
    # The probabilities of the classes.
    classes = [(c, offsets, same, conf, shared, q) for c in ("STANDARD", "SMALL", "PROMO") for offsets, same, conf, shared, q in ((gates.STRONG, False, True, True, 0.75), (gates.STRONG, False, False, True, 0.57), ((1, 2), False, True, False, 0.51))]
    return gates.offset_classes(links.select("s1", "rid", "country", "d", "same_name"), classes)


@query()
def hidden_offsets(spark, sf_dir):
    """Links that go by the symmetry of single changed numbers (tested by a hand-made case)."""
    return gates.hidden_offsets(_house_links(spark, sf_dir))


_LABEL = "regexp_extract(lower(url), '(?:https?://)?(?:www\\.)?([a-z0-9][a-z0-9\\-]*)\\.(?:co\\.in|com|net|org|in|fr|co|biz|info|us|io)\\b', 1)"


@query(f"SELECT page_id, is_domain, CASE WHEN is_domain THEN {_UNLEET} ELSE '' END AS last_word FROM (SELECT page_id, label <> '' AS is_domain, list_filter(string_split(label, '-'), lambda x: x <> '')[-1] AS w FROM (SELECT page_id, {_LABEL} AS label FROM pages WHERE url IS NOT NULL))")
def name_domains(spark, sf_dir):
    """The parser's output: whether a url is a domain, and the last word of its name, which is the label's."""
    rows = records.parsed_names(adapters.table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", "url"), "url")
    return rows.select("page_id", "is_domain", F.when(F.col("is_domain"), F.element_at("name_full", -1)).otherwise("").alias("last_word"))


@query()
def parsed_records(spark, sf_dir):
    """Names and addresses of the people adapter by dictionaries (accents go in Python; tested by hand-made cases)."""
    rows = records.parsed_names(adapters.people(spark, sf_dir), "business_name", _DICTS)
    rows = records.parsed_addresses(rows, "business_address", "country", _DICTS)
    lists = ("name_full", "name_core", "name_alt", "addr_words", "addr_numbers", "city")
    return rows.select("entity_id", "is_domain", "is_dba", "state", "pin", *(F.array_join(c, "|").alias(c) for c in lists))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[ऀ-ൿ]')")
def transliterated_texts(spark, sf_dir):
    """Texts without Indic letters stay as they are, whole."""
    d = adapters.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.filter(~F.col("text").rlike("[ऀ-ൿ]")).select("doc_id", F.char_length(transliterated(F.col("text"))).cast("long").alias("n"))


@query()
def transliterated_documents(spark, sf_dir):
    """All texts, transliterated (those with Indic letters are held against a plain version in a test)."""
    d = adapters.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", transliterated(F.col("text")).alias("text"))
