"""Normalised keys of names and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal forms and stop words that don't count in a core name.
LEGAL_WORDS = ("llc", "inc", "incorporated", "ltd", "limited", "pvt", "private", "company", "co", "corp", "corporation", "the", "of", "and")
MIN_TOKEN = 4
# Fixed value: a house number.
HOUSE_NUMBER = r"(?:^|[\s,#])0*(\d{1,6})(?:[A-Za-z]?\b|[-/ ])"
# Digits read as letters in mixed tokens.
LEET_FROM, LEET_TO = "01345678", "oleasgtb"
ORDINAL = r"^[0-9]+(er|ere|eme|e|st|nd|rd|th|hr)$"


def norm(c: Column) -> Column:
    """Lower-cased ASCII words with single blanks; '' and 'nan' are null."""
    words = F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9]+", " ")))
    return F.nullif(F.nullif(words, F.lit("")), F.lit("nan"))


def tokens(c: Column) -> Column:
    """Words of a normalised text (null: none)."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.split(c, " "))


def sorted_words(words: Column) -> Column:
    return F.nullif(F.array_join(F.array_sort(words), " "), F.lit(""))


def core_tokens(words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*LEGAL_WORDS))


def number_runs(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]{2,}"), F.lit(0))


def normalized(entities: DataFrame) -> DataFrame:
    """The eleven columns that the linker reads."""
    rows = entities.select("entity_id", norm(F.col("business_name")).alias("n_name"), norm(F.col("business_address")).alias("n_addr"), "country")
    name, addr = tokens(F.col("n_name")), tokens(F.col("n_addr"))
    long = lambda w: F.length(w) >= MIN_TOKEN
    return rows.select(
        "entity_id", "n_name", "n_addr", "country", sorted_words(name).alias("n_sorted"), sorted_words(core_tokens(name)).alias("n_core_sorted"), sorted_words(addr).alias("a_sorted"),
        F.filter(name, long).alias("name_tokens"), F.filter(addr, long).alias("addr_tokens"), number_runs(F.col("n_name")).alias("name_nums"), number_runs(F.col("n_addr")).alias("addr_nums"),
    )


NORM_SQL = f"""norm0 AS (SELECT entity_id, country, nullif(nullif(trim(lower(regexp_replace(coalesce(business_name, ''), '[^a-zA-Z0-9]+', ' ', 'g'))), ''), 'nan') AS n_name,
  nullif(nullif(trim(lower(regexp_replace(coalesce(business_address, ''), '[^a-zA-Z0-9]+', ' ', 'g'))), ''), 'nan') AS n_addr FROM src),
norm1 AS (SELECT *, CASE WHEN n_name IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(n_name, ' ') END AS nt, CASE WHEN n_addr IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(n_addr, ' ') END AS at_ FROM norm0),
norm AS (SELECT entity_id, n_name, n_addr, country, nullif(array_to_string(list_sort(nt), ' '), '') AS n_sorted,
  nullif(array_to_string(list_sort(list_filter(nt, lambda w: length(w) >= 2 AND w NOT IN ({", ".join(f"'{w}'" for w in LEGAL_WORDS)}))), ' '), '') AS n_core_sorted,
  nullif(array_to_string(list_sort(at_), ' '), '') AS a_sorted, list_filter(nt, lambda w: length(w) >= {MIN_TOKEN}) AS name_tokens, list_filter(at_, lambda w: length(w) >= {MIN_TOKEN}) AS addr_tokens,
  regexp_extract_all(coalesce(n_name, ''), '[0-9]{{2,}}') AS name_nums, regexp_extract_all(coalesce(n_addr, ''), '[0-9]{{2,}}') AS addr_nums FROM norm1)"""


def unleet(word: Column) -> Column:
    """Digits read as letters where a word mixes both, unless it is an ordinal."""
    mixed = word.rlike("[a-z]") & word.rlike("[0-9]") & ~word.rlike(ORDINAL)
    return F.when(mixed, F.translate(word, LEET_FROM, LEET_TO)).otherwise(word)


def name_words(c: Column) -> Column:
    """Words of a name: & and + are 'and', apostrophes and dots vanish, mixed words are unleeted."""
    s = F.lower(F.coalesce(c, F.lit("")))
    for mark in ("&", "+"):
        s = F.replace(s, F.lit(mark), F.lit(" and "))
    s = F.regexp_replace(s, "['’.]", "")
    return F.transform(F.filter(F.split(s, "[^a-z0-9]+"), lambda w: w != ""), unleet)


def house_number(c: Column) -> Column:
    """The number at the start of an address or after a blank, comma or number sign; leading zeros don't count."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), HOUSE_NUMBER, 1), F.lit("")), F.lit("999999")).cast("long")


def sample_bucket(c: Column, n: int) -> Column:
    """Portable hash of an id modulo n."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("long")
