"""Names and addresses parsed by dictionaries (N1-N3, N7-N11): all dictionaries are parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scripts import literal_map, transliterated
from ..functions.text import strip_accents_column
from .normalize import name_words

# Patterns of web domains and of "doing business as".
DOMAIN = r"(?i)(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9\-]*)\.(?:co\.in|com|net|org|in|fr|co|biz|info|us|io)\b"
DBA = r"(?i)\s+(?:doing business as|d\s*/\s*b\s*/\s*a|d\.b\.a\.?|dba|t\s*/\s*a|trading as|a\s*/\s*k\s*/\s*a|aka|f\s*/\s*k\s*/\s*a|fka|formerly known as|formerly)\s*:?\s+"
# Words that don't count in a core name, and address components that say nothing.
NAME_STOP = (
    "pvt", "ltd", "corp", "inc", "co", "llc", "llp", "lp", "plc", "pc", "pllc", "the", "and", "of", "sarl", "sas", "sasu", "eurl", "sa", "ei", "sci", "snc", "scop", "selarl", "scm",
    "opc", "le", "la", "les", "de", "du", "des", "d", "l", "a", "an", "dba", "aka", "fka", "et", "fils", "null", "na", "none",
)
PLACEHOLDERS = ("null", "<null>", "n/a", "na", "none")
DIGITS_OF_PIN = {"India": 6}


@dataclass(frozen=True)
class Dictionaries:
    """Word lists of a deployment: learned Indic words, canonical name words, and by country canonical address words
    (an empty word drops the token) and states by their names. A country without its own list has the list of ''."""

    indic: dict[str, str] = field(default_factory=dict)
    name: dict[str, str] = field(default_factory=dict)
    address: dict[str, dict[str, str]] = field(default_factory=dict)
    states: dict[str, dict[str, str]] = field(default_factory=dict)


def _of(word: Column, words: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(literal_map(words), word), word) if words else word


def _latin(c: Column, d: Dictionaries) -> Column:
    return strip_accents_column(transliterated(F.coalesce(c, F.lit("")), d.indic))


def parsed_names(rows: DataFrame, column: str, d: Dictionaries = Dictionaries(), accents: bool = True) -> DataFrame:
    """Adds name_full, name_core, name_alt (words), is_domain and is_dba. A web domain gives way to its label at the
    end of the name; of 'x doing business as y' y is the name and x the alias. Null and empty names have no words."""
    s = _latin(F.col(column), d) if accents else transliterated(F.coalesce(F.col(column), F.lit("")), d.indic)
    rows = rows.withColumn("__s", s).withColumn("__label", F.regexp_extract("__s", DOMAIN, 1))
    rest = F.trim(F.replace(F.regexp_replace("__s", DOMAIN, " "), F.lit("|"), F.lit(" ")))
    plain = F.when(F.col("__label") != "", F.concat_ws(" ", F.nullif(rest, F.lit("")), "__label")).otherwise(F.col("__s"))
    rows = rows.withColumn("__parts", F.split(F.regexp_replace(F.replace(plain, F.lit("|"), F.lit(" ")), r"(?U)^\W+", ""), DBA))
    full, alias = (F.transform(name_words(F.col("__parts")[i]), lambda w: _of(w, d.name)) for i in (F.size("__parts") - 1, F.lit(0)))
    core = lambda words: F.filter(words, lambda w: ~w.isin(*NAME_STOP))
    rows = rows.withColumn("name_full", full).withColumn("name_core", core(F.col("name_full")))
    rows = rows.withColumn("name_alt", F.when(F.size("__parts") > 1, core(alias)).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("is_domain", F.col("__label") != "").withColumn("is_dba", F.size("__parts") > 1).drop("__s", "__label", "__parts")


def _by_country(country: Column, lists: dict[str, dict[str, str]], of) -> Column:
    out = of(lists.get("", {}))
    for name, words in lists.items():
        out = F.when(country == name, of(words)).otherwise(out) if name else out
    return out


def parsed_addresses(rows: DataFrame, column: str, country: str, d: Dictionaries = Dictionaries(), pins: dict[str, int] | None = None, accents: bool = True) -> DataFrame:
    """Adds addr_words, addr_numbers, state, pin and city from the components between commas. A component that is a
    state's name sets the state and is used up (the last one counts); placeholders are skipped; numbers lose leading
    zeros; a number of the country's postal length is the pin (the last one). city holds components without digits."""
    land, pins = F.col(country), DIGITS_OF_PIN if pins is None else pins
    s = F.lower(_latin(F.col(column), d) if accents else transliterated(F.coalesce(F.col(column), F.lit("")), d.indic))
    pieces = F.filter(F.transform(F.split(s, ","), lambda c: F.trim(c)), lambda c: (c != "") & ~c.isin(*PLACEHOLDERS))
    key = lambda c: F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, "[^a-z0-9& ]+", " "), F.lit("&"), F.lit(" and ")), " +", " "))
    state = lambda c: _by_country(land, d.states, lambda words: F.try_element_at(literal_map(words), key(c)) if words else F.lit(None).cast("string"))
    bare = lambda w: F.when(w.rlike("^[0-9]+$"), F.regexp_replace(w, "^0+(?=[0-9])", "")).otherwise(w)
    canon = lambda w: _by_country(land, d.address, lambda words: _of(bare(w), words))
    split = lambda c: F.filter(F.transform(F.filter(F.split(F.replace(c, F.lit("'"), F.lit("")), "[^a-z0-9]+"), lambda w: w != ""), canon), lambda w: w != "")
    rows = rows.withColumn("__all", F.transform(pieces, lambda c: F.struct(c.alias("c"), state(c).alias("state"))))
    rows = rows.withColumn("__rest", F.transform(F.filter("__all", lambda p: p["state"].isNull()), lambda p: F.struct(p["c"].alias("c"), split(p["c"]).alias("words"))))
    rows = rows.withColumn("state", F.coalesce(F.try_element_at(F.filter(F.transform("__all", lambda p: p["state"]), lambda x: x.isNotNull()), F.lit(-1)), F.lit("")))
    rows = rows.withColumn("addr_words", F.flatten(F.transform("__rest", lambda p: p["words"])))
    rows = rows.withColumn("__runs", F.flatten(F.transform("__rest", lambda p: F.regexp_extract_all(p["c"], F.lit("[0-9]+"), F.lit(0)))))
    length = F.lit(None).cast("int")
    for name, n in pins.items():
        length = F.when(land == name, n).otherwise(length)
    rows = rows.withColumn("pin", F.coalesce(F.try_element_at(F.filter("__runs", lambda n: F.length(n) == length), F.lit(-1)), F.lit("")))
    rows = rows.withColumn("addr_numbers", F.transform("__runs", lambda n: F.regexp_replace(n, "^0+(?=[0-9])", "")))
    inner = F.filter("__rest", lambda p: ~p["c"].rlike("[0-9]") & (F.size(p["words"]) > 0))
    return rows.withColumn("city", F.transform(inner, lambda p: F.array_join(p["words"], " "))).drop("__all", "__rest", "__runs")


def learned_words(links: DataFrame, source: str, target: str, least: int = 2) -> DataFrame:
    """Word pairs at equal places of linked word lists of one length: per source word its most frequent counterpart,
    the smallest of equally frequent ones, seen at least so often. Columns word, counterpart, n."""
    even = links.filter((F.size(source) == F.size(target)) & (F.size(source) > 0))
    both = even.select(F.explode(F.arrays_zip(F.col(source).alias("a"), F.col(target).alias("b"))).alias("p")).filter("p.a <> ''")
    counts = both.groupBy(F.col("p.a").alias("word"), F.col("p.b").alias("counterpart")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("word").orderBy(F.desc("n"), "counterpart")
    return counts.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") == 1).filter(F.col("n") >= least).drop("rn")
