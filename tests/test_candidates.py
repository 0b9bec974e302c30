"""Evidence candidates against a plain version, record features and policies by hand."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from lakelink.functions import text
from lakelink.operators import evidence, policy, record_features


def _digest(s):
    return hashlib.sha256(s.encode()).hexdigest()[:12]


def _plain(left, right, top):
    words = lambda s: {w for w in s.split() if len(w) >= 2 and w not in evidence.STOP}
    grams = lambda s: {f" {s.replace(' ', '')} "[i : i + 3] for i in range(len(s.replace(" ", "")))} if s else set()
    routes = {"name_word": (1, words), "gram": (1, grams), "second_word": (2, words)}
    out = []
    for sid, name, second in left:
        counts = {}
        for route, (i, keys) in routes.items():
            for key in keys((sid, name, second)[i]):
                held = sorted((r[0] for r in right if key in keys(r[i])), key=lambda t: (_digest(f"d:{t}:{key}"), t))
                for t in held[: evidence.SAMPLES[route]]:
                    counts.setdefault(t, Counter())[route] += 1
        scored = []
        for t, tname, tsecond in right:
            same = 100.0 if name and name == tname else 95.0 if second and second == tsecond else 0.0
            if not same and t not in counts:
                continue
            c = counts.get(t, Counter())
            e = same + sum(w * c[r] for r, w in evidence.WEIGHTS.items())
            n, s = text.w_ratio(name, tname), text.token_set_ratio(second, tsecond)
            scored.append((round(max(n, 0.7 * n + 0.3 * s) + min(e, 20.0) / 20.0, 6), _digest(t), t))
        scored.sort(key=lambda x: (-x[0], x[1], x[2]))
        out += [(sid, t, score, i + 1) for i, (score, _, t) in enumerate(scored[:top])]
    return sorted(out)


def test_evidence_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(evidence, "SAMPLES", {"name_word": 4, "gram": 5, "second_word": 3})
    random.seed(3)
    said = lambda k: " ".join(random.choices(["red", "gear", "the", "x", "bolt", "redgear", "ox"], k=random.randrange(k)))
    rows = [(f"{i}", said(4), said(3)) for i in range(70)] + [(f"h{i}", "red gear", "main st") for i in range(12)]
    left, right = [r for r in rows if r[0][-1] in "13"], [r for r in rows if r[0][-1] not in "13"]
    schema = "entity_id string, name string, second string"
    nulls = lambda rs: [(i, n or None, s or None) for i, n, s in rs]
    got = evidence.evidence_candidates(spark.createDataFrame(nulls(left), schema), spark.createDataFrame(nulls(right), schema), "d", top=5)
    assert sorted(tuple(r) for r in got.select("sid", "tid", "score", F.col("rank").cast("int")).collect()) == _plain(left, right, 5)


SCHEMA = "entity_id string, country string, name_full array<string>, name_core array<string>, name_alt array<string>, addr_words array<string>, addr_numbers array<string>, city array<string>, state string, pin string, is_domain boolean, is_dba boolean, is_native boolean"


def test_record_features_by_hand(spark):
    rows = [
        ("S1-1", "X", ["acme", "tool", "ltd"], ["acme", "tool"], [], ["5", "elm", "york"], ["5"], ["elm", "york"], "ny", "", False, False, False),
        ("S1-2", "X", ["bolt"], ["bolt"], [], [], [], [], "", "", False, False, False),
        ("S2-1", "X", ["acme", "tools", "ltd", "co"], ["acme", "tools"], ["tool"], ["7", "elm", "york"], ["7"], ["york"], "ny", "12345", True, True, False),
        ("S2-2", "X", None, None, None, None, None, None, None, None, None, None, None),
    ]
    pairs = spark.createDataFrame([("S2-1", "S1-1", 4.0, 3, 1), ("S2-1", "S1-2", 1.0, 1, 2), ("S2-2", "S1-1", 0.0, 1, 1)], "rid string, s1 string, bscore double, nkeys long, brank long")
    got = {(r["rid"], r["s1"]): r.asDict() for r in record_features.record_features(pairs, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {("S2-1", "S1-1"), ("S2-2", "S1-1")}
    r = got["S2-1", "S1-1"]
    want = {"qn_len": 2, "sn_len": 2, "n_inter": 1, "a_inter": 2, "m_inter": 0, "num1_eq": 0, "state_eq": 1, "pin_eq": -1, "first_tok_eq": 1, "legal_eq": 2, "is_domain": 1, "q_addr_empty": 0, "qn_chars": 10, "brel": 1.0, "q_ncand": 1, "alt_tset": 100.0, "city_last": 100.0, "n_cont": 0.5}
    assert {k: r[k] for k in want} == want
    assert abs(r["n_ratio"] - text.ratio("acme tools", "acme tool")) < 1e-3 and abs(r["cc_jw"] - text.jaro_winkler("acmetools", "acmetool")) < 1e-3
    assert abs(r["wn_hw"] - 0.693147) < 1e-5 and abs(r["wn_qmiss"] - 1.386294) < 1e-5
    empty = got["S2-2", "S1-1"]
    assert empty["qn_len"] == 0 and empty["first_tok_eq"] == -1 and empty["legal_eq"] == -1 and empty["alt_tset"] == -1 and empty["brel"] is None and empty["wn_wj"] == 0


def test_policies(spark):
    scored = spark.createDataFrame([("a", "1", 0.9), ("a", "2", float("nan")), ("a", "3", float("inf")), ("a", "4", None), ("a", "5", 0.9), ("a", "6", 0.8), ("b", "7", 0.1)], "sid string, tid string, score double")
    assert [tuple(r) for r in policy.choose_matches(scored, 0.5, 2).orderBy("rank").collect()] == [("a", "1", 0.9, 1), ("a", "5", 0.9, 2)]
    metrics = spark.createDataFrame([("union_recall", 4.39), ("precision", 0.5), ("mean_cands", 1.0), ("median_cands", 2.0)], "name string, value double")
    assert sorted(r["name"] for r in policy.impossible_metrics(metrics).collect()) == ["median_cands", "union_recall"]
    lists = spark.createDataFrame([("a", "3,1,2"), ("b", "")], "source1_entity_id string, matched_entity_ids string")
    gone = spark.createDataFrame([("a", "1")], "sid string, tid string")
    assert sorted(tuple(r) for r in policy.without(lists, gone).collect()) == [("a", "3,2"), ("b", "")]
    scores = spark.createDataFrame([("a", 1, 2, 1), ("b", 0, 0, 0)], "sid string, tp long, n_pred long, n_gold long")
    assert sorted(tuple(r) for r in policy.after_removal(scores).collect()) == [("a", 0.555556, 0.0, 1.0), ("b", 1.0, 1.0, 1.0)]
    assert policy.score_grid(scored.limit(0), 5).count() == 0
