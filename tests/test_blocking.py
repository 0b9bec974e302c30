"""Scored keys by hand, arrivals against the batch result, group sizes against listed pairs."""

from pyspark.sql import functions as F

from lakelink.operators import blocking, normalize
from lakelink.sources import adapters
from lakelink.streaming import arrivals

SF = "/root/testdata/sf0.001"
SCHEMA = "entity_id string, country string, name_core array<string>, name_alt array<string>, addr_words array<string>, pin string"


def _keys(spark, *row):
    rows = blocking.scored_keys(spark.createDataFrame([("S1-1", "X", *row)], SCHEMA)).collect()
    return {(r["kind"], r["k"]) for r in rows}, {r["no_address"] for r in rows}


def test_keys_of_all_kinds(spark):
    keys, bare = _keys(spark, ["blue", "mountains"], ["b", "acme"], ["12", "main", "elm", "12", "oakwood", "street"], "110001")
    names, parts = ["blue", "mountains", "acme", "~bluemo", "~mounta"], ["12", "oakwood", "elm", "pin110001"]
    want = {(0, f"{n}|{a}") for n in names for a in parts} | {(4, n) for n in names} | {(3, "blue mountains")}
    want |= {(1, "acme|blue"), (1, "acme|mountains"), (1, "blue|mountains"), (2, "12|oakwood"), (2, "12|elm"), (2, "elm|oakwood")}
    assert keys == want and bare == {False}


def test_keys_of_empty_and_null_records(spark):
    assert _keys(spark, [], [], [], "") == (set(), set())
    assert _keys(spark, None, None, None, None) == (set(), set())
    assert _keys(spark, ["ab"], None, None, None) == ({(3, "ab"), (4, "ab")}, {True})


def test_arrivals_equal_the_batch(spark, tmp_path):
    rows = adapters.parts(spark, SF)
    s1, targets = blocking.sides(rows)
    index, inbox, out = (str(tmp_path / n) for n in ("index", "inbox", "out"))
    arrivals.write_index(s1, index)
    targets.write.parquet(inbox)
    stream = spark.readStream.schema(targets.schema).parquet(inbox)
    query = arrivals.link_arrivals(stream, index, lambda links, n: links.write.mode("append").parquet(out), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    want = blocking.scored_candidates(blocking.key_records(normalize.normalized(rows)), 1).select("rid", "s1", F.col("bscore").alias("score"))
    assert sorted(spark.read.parquet(out).collect()) == sorted(want.collect()) != []


def test_channel_volume_counts_listed_pairs(spark):
    norm = normalize.normalized(adapters.people(spark, SF))
    listed = blocking.channel_pairs(norm).groupBy("prio").agg(F.count("*").alias("n_raw"))
    assert sorted(blocking.channel_volume(norm).collect()) == sorted(listed.collect())
