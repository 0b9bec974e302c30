"""License scans by ordered signature rules, in DataFrame functions only.

Some hundred regular expressions, made of license families, versions and wordings, are tried in the
order of their priority. A rule runs on a text only if the text holds the rule's keyword, and no
rule runs on a text that holds none of the gate's words, which is most texts. A detection is an
interval of words. Overlaps are resolved over all detections: those that lie within no other come first, in order of
their rules' priority, then those within one, and so on; one that a standing detection overlaps or contains is dropped,
so what lay within a dropped one is free again. The labels of what is left stand beside those of the base phrases.

Words are runs of characters other than ASCII marks, white space and control characters; A-Z are
lower-cased (by case-blind matching of ASCII letters only). All of it is done within a row: there is no shuffle,
and copies or hot sources land in no common task.

Defined results: null and empty texts have 0 words, no labels ('') and score 0. Repeated rows get
equal results. score is the share of the words that lie in standing detections, at most 1.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Java matches these some twenty times faster than the same classes written as unions of ranges.
SEPARATOR = r"[^\p{Alnum}\x{80}-\x{10FFFF}]"
_WORD = r"[\p{Alnum}\x{80}-\x{10FFFF}]"

#: Phrases of words (lower-cased) and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Pieces (lower-cased) of which a text must hold one before any rule runs on it: of single words, so that it does not
#: matter what stands between the words of a rule.
GATE = ["licens", "licenc", "copyright", "gpl", "apache", "commons", "cc by", "cc-by", "cc_by", "cc\nby", "cc\tby", "cc0", "spdx", "domain", "reserved", "wtfpl", "bsd", "permission", "redistribution", "proprietary", "unencumbered"]


def signatures() -> list[tuple[str, str]]:
    """(words of the signature, label) in order of priority. In the words, a|b are choices and a
    trailing ? marks a word that may be missing."""
    out: list[tuple[str, str]] = []
    add = lambda words, label: out.append((words, label))
    gnu = [("gpl", "general", ("1", "2", "3")), ("lgpl", "lesser|library general", ("2", "2 1", "3")), ("agpl", "affero general", ("1", "3"))]
    for short, name, versions in gnu:
        for v in versions:
            label = f"{short}-{v.replace(' ', '.')}"
            zero = "" if " " in v else " 0?"
            add(f"spdx license identifier {short} {v}{zero} or later", label + "-or-later")
            add(f"spdx license identifier {short} {v}{zero} only?", label)
            add(f"gnu {name} public license version|v {v}{zero} or at? your? option? any? later", label + "-or-later")
            add(f"version {v}{zero} or later of the gnu {name} public license", label + "-or-later")
            add(f"gnu {name} public license as? published? by? the? free? software? foundation? version {v}{zero}", label)
            add(f"version {v}{zero} of the gnu {name} public license", label)
            add(f"{name} public license v{v.split()[0]}", label)
            add(f"{short} version|v {v}{zero} or later", label + "-or-later")
            add(f"{short} version|v {v}{zero}", label)
            add(f"{short}v{v.split()[0]}{' ' + v.split()[1] if ' ' in v else ''}", label)
        add(f"gnu {name} public license", short)
        add(f"licensed under the {short}", short)
    for v in ("1 0", "1 1", "2 0", "2"):
        label = f"apache-{v.replace(' ', '.')}"
        add(f"spdx license identifier apache {v}", label)
        add(f"licensed under the apache license version {v}", label)
        add(f"apache software? license version? v? {v}", label)
    add("apache software? license", "apache")
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        label = "cc-" + parts.replace(" ", "-")
        long = {"by": "attribution", "by sa": "attribution share alike|sharealike", "by nc": "attribution non? commercial|noncommercial", "by nd": "attribution no derivatives|noderivatives|noderivs", "by nc sa": "attribution non? commercial|noncommercial share alike|sharealike", "by nc nd": "attribution non? commercial|noncommercial no derivatives|noderivatives|noderivs"}[parts].replace("share alike|sharealike", "share? alike|sharealike").replace("no derivatives|noderivatives|noderivs", "no? derivatives|noderivatives|noderivs")
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            add(f"licensed? under? cc {parts} {v}", f"{label}-{v.replace(' ', '.')}")
            add(f"creative commons {long} {v}", f"{label}-{v.replace(' ', '.')}")
            add(f"creative commons {long} {v} international|unported|generic license", f"{label}-{v.replace(' ', '.')}")
        add(f"cc {parts}", label)
        add(f"creative commons {long} license?", label)
    for words in ("cc0 1 0", "cc0", "creative commons zero", "creative commons public domain dedication"):
        add(words, "cc0-1.0")
    for n, name in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        for wording in (f"bsd {n} clause", f"{n} clause bsd license?", f"{name} clause bsd license?", f"spdx license identifier bsd {n} clause"):
            add(wording, f"bsd-{n}-clause")
    for wording in ("simplified bsd license", "freebsd license"):
        add(wording, "bsd-2-clause")
    for wording in ("new bsd license", "modified bsd license", "revised bsd license"):
        add(wording, "bsd-3-clause")
    add("original bsd license", "bsd-4-clause")
    add("bsd style? license", "bsd")
    for name, label, versions in (("mozilla public license", "mpl", ("1 0", "1 1", "2 0", "2")), ("eclipse public license", "epl", ("1 0", "2 0", "2")), ("common development and distribution license", "cddl", ("1 0", "1 1")), ("european union public licence|license", "eupl", ("1 0", "1 1", "1 2")), ("academic free license", "afl", ("1 1", "2 0", "2 1", "3 0")), ("open software license", "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")), ("artistic license", "artistic", ("1 0", "2 0", "2")), ("boost software license", "bsl", ("1 0",)), ("common public license", "cpl", ("1 0",)), ("lucent public license", "lpl", ("1 0", "1 02")), ("microsoft public license", "ms-pl", ()), ("microsoft reciprocal license", "ms-rl", ()), ("sil open font license", "ofl", ("1 0", "1 1")), ("open database license", "odbl", ("1 0",)), ("open data commons attribution license", "odc-by", ("1 0",)), ("zope public license", "zpl", ("1 1", "2 0", "2 1")), ("php license", "php", ("3 0", "3 01")), ("python software foundation license", "psf", ("2", "2 0")), ("server side public license", "sspl", ("1", "1 0")), ("business source license", "busl", ("1 0", "1 1")), ("elastic license", "elastic", ("1 0", "2 0", "2")), ("university of illinois ncsa open source license", "ncsa", ()), ("educational community license", "ecl", ("1 0", "2 0")), ("reciprocal public license", "rpl", ("1 1", "1 5")), ("sleepycat license", "sleepycat", ()), ("vim license", "vim", ()), ("openssl license", "openssl", ()), ("polyform noncommercial license", "polyform-nc", ("1 0 0",))):
        for v in versions:
            add(f"{name} version|v? {v}", f"{label}-{v.replace(' ', '.')}")
            add(f"version {v} of the {name}", f"{label}-{v.replace(' ', '.')}")
        add(name, label)
    for words, label in (("permission is hereby granted free of charge to any person obtaining a copy", "mit"), ("released|licensed|distributed|available under the terms? of? the? mit license", "mit"), ("spdx license identifier mit", "mit"), ("the mit license mit?", "mit"), ("mit license", "mit"), ("expat license", "mit"), ("x11 license", "x11"), ("isc license", "isc"), ("permission to use copy modify and or? distribute this software for any purpose", "isc"), ("zlib libpng? license", "zlib"), ("the unlicense", "unlicense"), ("this is free and unencumbered software released into the public domain", "unlicense"), ("do what the fuck you want to public license", "wtfpl"), ("wtfpl version? 2?", "wtfpl"), ("beerware license", "beerware"), ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"), ("dedicated|released to|into the public domain", "public-domain"), ("in the public domain", "public-domain"), ("all rights reserved", "proprietary"), ("proprietary and confidential", "proprietary"), ("gnu free documentation license", "gfdl"), ("gnu free documentation license version 1 1|2|3", "gfdl-1"), ("open government licence|license", "ogl"), ("json license", "json"), ("postgresql license", "postgresql"), ("ruby license", "ruby"), ("blue oak model license", "blueoak")):
        add(words, label)
    return out


def keyword(words: str) -> str:
    """The longest run of words that each match of the signature holds, with single blanks."""
    runs, run = [], []
    for w in [*words.split(), "?"]:
        if w.endswith("?") or "|" in w:
            runs.append(" ".join(run))
            run = []
        else:
            run.append(w)
    return max(runs, key=len)


def to_regex(words: str) -> str:
    """The signature as a regular expression over whole words of the raw text."""
    out = ""
    for i, w in enumerate(words.split()):
        missing = w.endswith("?")
        choices = "|".join(x.replace(".", "\\.") for x in w.rstrip("?").split("|"))
        w = f"(?:{choices})"
        if i == 0:
            out = f"(?:{w}{SEPARATOR}+)?" if missing else w
            first_missing = missing
        elif first_missing:
            out += f"(?:{w}{SEPARATOR}+)?" if missing else w
            first_missing = missing
        else:
            out += f"(?:{SEPARATOR}+{w})?" if missing else f"{SEPARATOR}+{w}"
    return f"(?i)(?<!{_WORD}){out}(?!{_WORD})"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row: the optimizer would copy it into the lambdas of body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words_in(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{_WORD}+"))


def _places(text: Column, regex: Column, priority: Column, label: Column) -> Column:
    """Array of (start, end, priority, label), in words, of the regex's matches in text."""
    pieces = F.transform(F.split(text, regex, -1), _words_in)
    matched = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), _words_in)
    # Words before match i: those of the pieces up to i and of the matches before it.
    spans = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matched)).alias("p"), matched.alias("m"))
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>").alias("out")),
        lambda s, x: F.struct((s["at"] + x["p"] + x["m"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["p"]).alias("start"), (s["at"] + x["p"] + x["m"]).alias("end"), priority.alias("priority"), label.alias("label")))).alias("out")),
    )
    return state["out"]


def _standing(found: Column) -> Column:
    """Labels and number of words of what stands after the overlaps of an array of detections are resolved: those within
    fewest others first, then by priority, then the longer, then the earlier; each stands unless one that stands overlaps it."""

    def within(d: Column) -> Column:
        around = lambda x: (x["start"] <= d["start"]) & (d["end"] <= x["end"]) & ((x["start"] < d["start"]) | (d["end"] < x["end"]) | (x["priority"] < d["priority"]))
        return F.size(F.filter(found, around))

    ranked = F.transform(found, lambda d: F.struct(within(d).alias("depth"), d["priority"].alias("priority"), (d["start"] - d["end"]).alias("short"), d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label")))
    ordered = F.transform(F.array_sort(ranked), lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["priority"].alias("priority"), d["label"].alias("label")))

    def step(stand: Column, d: Column) -> Column:
        free = ~F.exists(stand, lambda x: (x["start"] < d["end"]) & (d["start"] < x["end"]))
        return F.when(free, F.concat(stand, F.array(d))).otherwise(stand)

    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    finish = lambda stand: F.struct(F.array_distinct(F.transform(stand, lambda d: d["label"])).alias("labels"), F.aggregate(stand, F.lit(0), lambda n, d: n + d["end"] - d["start"]).alias("words"))
    return F.aggregate(ordered, none, step, finish)


def scanned(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels, score, and detections (all places
    of all rules, in words)."""
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    keep = common.kept(df.columns if keep is None else keep, new)
    t = F.coalesce(F.col(text), F.lit(""))
    kind = "array<struct<start:int,end:int,priority:int,label:string>>"
    none = F.array().cast(kind)
    # "cc by" with other marks between its words
    gated = _let(F.lower(t), lambda x: reduce(or_, (F.contains(x, F.lit(g)) for g in GATE)) | (F.contains(x, F.lit("cc")) & x.rlike(f"cc{SEPARATOR}+by")))
    rows = df.select(*keep, t.alias("__text"), gated.alias("__gated"), _words_in(t).cast("long").alias("n_words"))
    t = F.col("__text")
    base = F.flatten(F.array(*(_places(t, F.lit(to_regex(p)), F.lit(0), F.lit(label)) for p, label in BASE)))
    # Base phrases hold words of the gate, so texts beyond it have none.
    rows = rows.withColumn("__base", F.when(F.col("__gated"), base).otherwise(none))
    rules = F.array(*(F.struct(F.lit(keyword(w)).alias("key"), F.lit(to_regex(w)).alias("regex"), F.lit(i + 1).alias("priority"), F.lit(label).alias("label")) for i, (w, label) in enumerate(signatures())))
    folded = F.regexp_replace(F.lower(t), f"{SEPARATOR}+", " ")
    due = _let(folded, lambda x: F.filter(rules, lambda r: F.contains(x, r["key"])))
    rows = rows.withColumn("__due", F.when(F.col("__gated"), due))
    all_places = F.flatten(F.transform(F.filter("__due", lambda r: F.rlike(t, r["regex"])), lambda r: _places(t, r["regex"], r["priority"], r["label"])))
    rows = rows.withColumn("detections", F.when(F.size("__due") > 0, all_places).otherwise(none))
    rows = rows.withColumn("__standing", F.when(F.size("detections") > 0, _standing(F.col("detections"))))
    base_labels = F.array_sort(F.array_distinct(F.transform("__base", lambda d: d["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce(F.col("__standing")["labels"], F.array().cast("array<string>"))))
    starts = F.transform("__base", lambda d: d["start"])
    score = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("__standing")["words"].cast("double"), F.col("n_words")), F.lit(0.0)))
    return rows.select(
        *keep, "n_words", F.size("__base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "detections",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).drop("detections")
