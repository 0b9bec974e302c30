import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakelink import audit_queries, catalog, policy_queries  # noqa: F401  (they register their queries)
from lakelink.functions import text
from lakelink.operators import blocking, decisions, metrics, normalize
from lakelink.plans import linker
from lakelink.sources import adapters, files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(frame: pd.DataFrame) -> list:
    def cell(x):
        return "NULL" if x is None or x is pd.NA or x != x else f"{float(x):.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert _rows(catalog.QUERIES[name](spark, SF).toPandas()) == _rows(con.execute(catalog.ORACLES[name]).fetch_df())


def test_soundex_values():
    assert [text.soundex(x) for x in ("robert", "rupert", "tymczak", "pfister", "ashcraft", "ghosh", "123", "नम")] == ["R163", "R163", "T522", "P236", "A261", "G200", "", ""]


def test_distances_equal_duckdb():
    random.seed(4)
    pairs = [("".join(random.choices("abc d", k=random.randrange(9))), "".join(random.choices("abc d", k=random.randrange(9)))) for _ in range(400)]
    con = duckdb.connect()
    con.execute("create table p (i int, a varchar, b varchar)")
    con.executemany("insert into p values (?, ?, ?)", [(i, *p) for i, p in enumerate(pairs)])
    want = con.execute("select damerau_levenshtein(a, b), jaro_winkler_similarity(a, b) from p order by i").fetchall()
    assert [int(x) for x in text.damerau(pairs)] == [w[0] for w in want]
    assert all(abs(text.jaro_winkler(*p) - w[1]) < 1e-9 for p, w in zip(pairs, want, strict=True))


def test_ratios():
    assert text.ratio("abc", "abc") == 100 and text.ratio("", "") == 100 and text.ratio("abcd", "abxd") == 75
    assert text.token_sort_ratio("b a", "a b") == 100
    assert text.token_set_ratio("a b c", "a b") == 100 and text.token_set_ratio("", "a") == 0
    assert text.partial_ratio("abc", "xxabcxx") == 100


def test_f05(spark):
    rows = spark.createDataFrame([(2, 3, 2), (0, 0, 0), (0, 1, 0), (1, 1, 2), (1, 2, 1)], "tp int, p int, g int")
    got = [r[0] for r in rows.select(metrics.f05(F.col("tp"), F.col("p"), F.col("g"))).collect()]
    assert got == pytest.approx([10 / 14, 1.0, 0.0, 5 / 6, 5 / 9])


def test_decisions(spark):
    rows = spark.createDataFrame([(0.5, 0.5), (0.9, 0.01), (None, 0.5), (float("nan"), 0.5), (0.4, 0.5)], "p2 double, p1 double")
    got = [r[0] for r in rows.select(decisions.decide(F.col("p2"), F.col("p1"), 0.5)).collect()]
    assert got == ["MATCH", "NO_CANDIDATE", "NO_CANDIDATE", "ABSTAIN", "ABSTAIN"]


def test_conflict_tie_takes_lower(spark):
    rows = spark.createDataFrame([("r", "S1-2", 0.5), ("r", "S1-1", 0.5), ("q", "S1-9", float("nan"))], "rid string, s1 string, score double")
    assert [tuple(r) for r in decisions.resolve_conflicts(rows).collect()] == [("r", "S1-1", 0.5)]


def test_names_and_houses(spark):
    rows = spark.createDataFrame([("c1ub", "12 main st"), ("mais0n 24hr", "#007 x"), ("21st & Co.", "no number")], "n string, a string")
    got = [(list(r[0]), r[1]) for r in rows.select(normalize.name_words(F.col("n")), normalize.house_number(F.col("a"))).collect()]
    assert got == [(["club"], 12), (["maison", "24hr"], 7), (["21st", "and", "co"], None)]


@pytest.mark.parametrize("cap", [2, 5, 1000])
def test_caps_lose_nothing_within_the_cap(spark, cap):
    """Targets that share several rare words count once in their channel."""
    rows = [(f"S1-{i}", "alpha bravo charlie", "1 main street", "US") for i in range(3)] + [(f"S{2 + i % 2}-{i:02d}", "alpha bravo delta" if i % 2 else "alpha bravo charlie", f"{i} main road", "US") for i in range(12)]
    norm = normalize.normalized(spark.createDataFrame(rows, files.ENTITY))
    pairs = blocking.channel_pairs(norm).collect()
    want = set()
    for sid in {p.sid for p in pairs}:
        per = {}
        for p in pairs:
            if p.sid == sid:
                per.setdefault(p.prio, set()).add(p.tid)
        best = {}
        for prio, tids in per.items():
            for t in sorted(tids)[:cap]:
                best[t] = min(prio, best.get(t, 99))
        want |= {(sid, t) for _, t in sorted((v, k) for k, v in best.items())[:cap]}
    assert {(r.sid, r.tid) for r in blocking.candidates(blocking.channel_pairs(norm), cap).collect()} == want


def test_files_round_trip(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "quoted" name\t\tUS\n')
    assert [tuple(r) for r in files.read_tsv(spark, str(p)).collect()] == [("S1-1", 'A "quoted" name', None, "US")]
    p.write_text("entity_id\tname\tbusiness_address\tcountry\nS1-1\tx\ty\tUS\n")
    with pytest.raises(Exception, match="(?i)header|CSV"):
        files.read_tsv(spark, str(p)).collect()
    truth = spark.createDataFrame([("S1-1", "S2-2, S2-1,,S2-1"), ("S1-2", None)], files.TRUTH)
    assert sorted(tuple(r) for r in files.edges(truth).distinct().collect()) == [("S1-1", "S2-1"), ("S1-1", "S2-2")]
    universe = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    out = files.match_lists(universe, files.edges(truth)).orderBy("source1_entity_id")
    files.write_tsv(out, str(tmp_path / "out.tsv"), out.columns)
    assert (tmp_path / "out.tsv").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-2\nS1-2\t\n"


def test_steps_run_once(tmp_path):
    r = files.StepRunner(str(tmp_path / "m.json"))
    steps = {"a": ["true"], "b": ["true"]}
    assert r.run(steps) == ["a", "b"] and r.run(steps) == []
    assert r.run(steps | {"a": ["true", "x"]}) == ["a"]
    with pytest.raises(RuntimeError):
        r.run({"c": ["false"]})


def test_linker_and_its_cache(spark, tmp_path):
    entities = adapters.parts(spark, SF)
    gold = catalog._gold(spark, SF)
    first = linker.run(spark, entities, gold, str(tmp_path), "k", cap=5)
    again = linker.run(spark, entities, gold, str(tmp_path), "k", cap=10)
    fresh = linker.run(spark, entities, gold, str(tmp_path / "fresh"), "k", cap=10)
    assert first["candidates"].count() == again["candidates"].count()
    assert sorted(map(tuple, again["candidates"].collect())) == sorted(map(tuple, fresh["candidates"].collect()))
    assert sorted(map(tuple, again["matches"].collect())) == sorted(map(tuple, fresh["matches"].collect()))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["source1_entity_id", "matched_entity_ids"] and df.count() > 0
