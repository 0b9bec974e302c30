"""Near-duplicate documents by b-bit MinHash.

A document's set holds the hashes of its distinct shingles. Of PERMUTATIONS minima the
low BITS bits are packed into a signature; bands of ROWS whole minima give candidates. The
collision-corrected similarity of two signatures comes from bit counts (in SQL functions), and pairs far below
the threshold go. What is left is confirmed on the full sets, made anew from the texts.

Copies (equal sets) are one node from the start, so a group of thousands of copies costs no
pair. Within a bucket all pairs are never listed: members are held against a few hubs (one that the buckets
of a family choose together, a second one for those far from it, the most central member). A pair of
two members can then be ruled out by what each has in common with the hub's group (see _across);
only pairs across components that this bound leaves open are confirmed one by one, so
no link is lost.

With 32 bands of 4 rows a pair of similarity 0.8 shares no band with a probability of 5e-8,
and the estimate of a true link falls below LEAST_ESTIMATE with one of 1e-9.

Defined results: null and empty texts have no set (n_shingles 0) and link with nothing; texts with fewer
words than a shingle have one of all their words. Rows without an id link with nothing and are kept. Rows of
an equal id are one document, that of their least text, and all have its result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected

BANDS, ROWS, BITS = 32, 4, 4
PERMUTATIONS = BANDS * ROWS
LEAST_ESTIMATE = 0.58
#: Estimated similarity from which a member of a bucket is held against the bucket's hub in full.
NEAR = 0.5
#: A shingle that the hub lacks counts as its group's if so many members, and one of so many, hold it.
OFTEN, OFTEN_SHARE = 8, 10
#: At most so many ids are broadcast to fetch the texts of candidates; more are joined by shuffle.
BROADCAST_IDS = 200_000
SEED = 4

_r = np.random.default_rng(SEED)
_MULTIPLY = _r.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _r.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BAND_MULTIPLY = _r.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for first, last in common.chunks(texts):
        hashes, offsets, _, _ = common.word_hashes(texts[first:last])
        out += [np.unique(common.shingles(hashes[a:b], k)) for a, b in zip(offsets, offsets[1:], strict=False)]
    return out


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, common.M64, np.uint64)
    for i in range(0, len(s), 4096):
        part = s[i : i + 4096]
        for j in range(0, PERMUTATIONS, 32):
            block = (part[None, :] ^ _FLIP[j : j + 32, None]) * _MULTIPLY[j : j + 32, None]
            out[j : j + 32] = np.minimum(out[j : j + 32], block.min(axis=1))
    return out


def signature(m: np.ndarray) -> list[int]:
    """The low BITS bits of the mixed minima, packed into 64-bit words."""
    low = common.mix64(m) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    return (low.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def band_keys(m: np.ndarray) -> list[int]:
    mixed = (m * _BAND_MULTIPLY).reshape(BANDS, ROWS)
    h = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        h = common.mix64(h + mixed[:, i] + np.uint64(i))
    return common.mix64(h + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


def signed(df: DataFrame, id_column: str, text: str, k: int) -> DataFrame:
    """(id, n, k1, k2, sig, bands) of each row: set size, digest of the set, signature, band keys."""
    common.python_ready(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, s in zip(frame["id"], shingle_sets([(t or "").encode() for t in frame["text"]], k), strict=True):
                if not len(s):
                    rows.append((i, 0, None, None, None, None))
                    continue
                m = minima(s)
                digest = np.array([np.bitwise_xor.reduce(common.mix64(s)), common.mix64(s + np.uint64(0x5BD1E995)).sum(dtype=np.uint64)]).view(np.int64)
                rows.append((i, len(s), int(digest[0]), int(digest[1]), signature(m), band_keys(m)))
            out = pd.DataFrame(rows, columns=["id", "n", "k1", "k2", "sig", "bands"])
            for c in ("id", "k1", "k2"):
                out[c] = out[c].astype("Int64")
            yield out

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id long, n long, k1 long, k2 long, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures of BITS = 4."""
    different = F.lit(0)
    for i in range(PERMUTATIONS * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        different = different + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111).cast("long")))
    by_chance = 2.0**-BITS
    return (1 - different / F.lit(float(PERMUTATIONS)) - by_chance) / (1 - by_chance)


def _sized(a: str, b: str, percent: int) -> Column:
    return F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) * 100 >= F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")) * percent


def _likely(a: str, b: str, percent: int) -> Column:
    """Neither the sizes nor the signatures rule a link out."""
    return _sized(a, b, percent) & (estimate(F.col(f"{a}.sig"), F.col(f"{b}.sig")) >= LEAST_ESTIMATE - (0.8 - percent / 100))


def _with_sketches(pairs: DataFrame, small: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the structs p and q of their set sizes and signatures."""
    return pairs.join(small.select(F.col("node").alias("a"), F.col("s").alias("p")), "a").join(small.select(F.col("node").alias("b"), F.col("s").alias("q")), "b")


def confirmed(pairs: DataFrame, df: DataFrame, id_column: str, text: str, k: int, percent: int) -> DataFrame:
    """(a, b, na, nb, both, link, novel) of pairs (a, b, grouped) from their full sets: the sizes, that of the
    intersection, whether 100 * both >= percent * union, and for grouped pairs the shingles of b that a lacks."""
    ids = common.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Rows come in the order of a, whose text most neighbours share.
            known: dict[str, np.ndarray] = {}
            out = []
            for a, b, grouped, ta, tb in zip(frame["a"], frame["b"], frame["grouped"], frame["ta"], frame["tb"], strict=True):
                if ta not in known:
                    known = {ta: shingle_sets([ta.encode()], k)[0]}
                x, y = known[ta], shingle_sets([tb.encode()], k)[0]
                both = len(np.intersect1d(x, y, assume_unique=True))
                novel = np.setdiff1d(y, x, assume_unique=True).view(np.int64) if grouped else None
                out.append((a, b, len(x), len(y), both, 100 * both >= percent * (len(x) + len(y) - both), novel))
            yield pd.DataFrame(out, columns=["a", "b", "na", "nb", "both", "link", "novel"])

    return rows.mapInPandas(run, "a long, b long, na long, nb long, both long, link boolean, novel array<long>")


def _enough(members: Column) -> Column:
    """Holders from which a shingle is one of its group's."""
    return F.greatest(F.lit(OFTEN), members / OFTEN_SHARE)


def _across(tested: DataFrame, near: DataFrame, far: DataFrame, found: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that may still be linked, after every member of a group was held against its hub.

    For any set P, |x & y| <= min(|x & P|, |y & P|) + |(x - P) & (y - P)|. P is the hub with all shingles that enough
    of its group have beyond it, so the last part is found by a join on shingles that few hold, and
    the first by the counts alone. A link needs (100 + percent) * |x & y| >= percent * (|x| + |y|)."""
    comp = found.select(F.col("node").alias("x"), "component")
    rare = near.select("h", "x", F.explode("novel").alias("g"))
    members = near.groupBy("h").agg(F.count("*").alias("members"))
    often = rare.groupBy("h", "g").agg(F.count("*").alias("holders")).join(members, "h").select("h", "g", "holders", (F.col("holders") >= _enough(F.col("members"))).alias("often"))
    rare = common.written(rare.join(often, ["h", "g"]).join(comp, "x", "left").withColumn("c", F.coalesce("component", "x")).select("h", "x", "g", "holders", "often", "c"), "novel")
    gained = rare.filter("often").groupBy("h", "x").agg(F.count("*").alias("gain"))
    sized = near.select("h", "x", "n", "both").join(gained, ["h", "x"], "left").join(comp, "x", "left")
    sized = common.written(sized.select("h", "x", "n", (F.col("both") + F.coalesce("gain", F.lit(0))).alias("cover"), F.coalesce("component", "x").alias("c")), "groups")
    need = lambda m, n: m * (100 + percent) >= percent * n
    # Covered by P alone. The most common component of a group is linked already; one side lies outside it.
    main = sized.groupBy("h", "c").agg(F.count("*").alias("m"), F.min("n").alias("least")).groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.min("least").alias("least"))
    outside = sized.join(main, "h").filter((F.col("c") != F.col("main")) & need(F.col("cover"), F.col("n") + F.col("least")))
    outside = outside.select("h", F.col("x").alias("a"), F.col("n").alias("na"), F.col("cover").alias("va"), F.col("c").alias("ca"))
    other = sized.select("h", F.col("x").alias("b"), F.col("n").alias("nb"), F.col("cover").alias("vb"), F.col("c").alias("cb"))
    by_cover = outside.join(other, "h").filter((F.col("ca") != F.col("cb")) & need(F.least("va", "vb"), F.col("na") + F.col("nb"))).select("a", "b")
    # With shingles that fewer hold.
    few = rare.filter("holders > 1 AND NOT often")
    split = few.groupBy("h", "g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("h", "g")
    few = few.join(split, ["h", "g"])
    shared = few.select("h", "g", F.col("x").alias("a"), F.col("c").alias("ca")).join(few.select("h", "g", F.col("x").alias("b"), F.col("c").alias("cb")), ["h", "g"])
    shared = shared.filter((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b"))).groupBy("h", "a", "b").agg(F.count("*").alias("more"))
    shared = shared.join(_side(sized, "a"), ["h", "a"]).join(_side(sized, "b"), ["h", "b"]).filter(need(F.least("va", "vb") + F.col("more"), F.col("na") + F.col("nb"))).select("a", "b")
    # Members of a bucket far from its hubs, against its other members.
    comp = comp.withColumnRenamed("x", "node")
    far = far.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).join(small, "node")
    left = far.filter(F.col("e0") < NEAR).select("key", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("e1").alias("ea"), F.col("s").alias("p"))
    right = far.select("key", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("e1").alias("eb"), F.col("s").alias("q"))
    apart = left.join(right, "key").filter((F.col("ca") != F.col("cb")) & (F.least("ea", "eb") < NEAR) & _likely("p", "q", percent)).select("a", "b")
    pairs = by_cover.unionAll(shared).unionAll(apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = _with_sketches(pairs, small).filter(_likely("p", "q", percent)).select("a", "b")
    return pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")


def _side(sized: DataFrame, side: str) -> DataFrame:
    return sized.select("h", F.col("x").alias(side), F.col("n").alias(f"n{side}"), F.col("cover").alias(f"v{side}"))


def classes(df: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of each row of df."""
    rows = common.written(signed(df, id_column, text, k), "signatures")
    if not rows.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty():
        one = common.one_each(df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL"))
        found = common.written(classes(one, "id", "text", k, percent), "classes")
        nameless = rows.filter("id IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
        return rows.select("id").join(found, "id").unionByName(nameless)
    sets = rows.filter("n > 0 AND id IS NOT NULL")
    nodes = sets.groupBy("k1", "k2", "n").agg(F.min("id").alias("node"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = common.written(nodes, "nodes")
    small = nodes.select("node", F.struct("n", "sig").alias("s"))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "low")
    shared = common.written(keys.join(hubs, "key"), "shared")
    # A node's buckets mostly hold the same others. Each node votes for the least node that it meets anywhere, and the buckets
    # of a family take one hub, in the bucket or not: a member is held against one hub or a few, not against one a band.
    voice = shared.groupBy("node").agg(F.min("low").alias("hub"))
    votes = shared.select("key", "node").join(voice, "node").groupBy("key", "hub").agg(F.count("*").alias("votes"))
    hubs = votes.groupBy("key").agg(F.max_by("hub", F.struct("votes", -F.col("hub"))).alias("low"))
    big = common.written(shared.select("key", "node").join(hubs, "key"), "buckets")
    common.dropped(shared)

    def near_hub(members: DataFrame, hub: str, name: str) -> DataFrame:
        to = members.select(F.col(hub).alias("a"), F.col("node").alias("b")).distinct()
        to = _with_sketches(to, small).select(F.col("a").alias(hub), F.col("b").alias("node"), estimate(F.col("p.sig"), F.col("q.sig")).alias(name))
        return members.join(to, [hub, "node"])

    # How near each member is to the hub, and those far from it to a second hub.
    big = common.written(near_hub(big, "low", "e0"), "near-hub")
    second = big.filter(F.col("e0") < NEAR).groupBy("key").agg(F.min("node").alias("hub"))
    big = common.written(near_hub(big.join(second, "key"), "hub", "e1").unionByName(big.join(second, "key", "left_anti"), allowMissingColumns=True), "near-hubs")
    grouped = big.filter(F.col("e0") >= NEAR).select(F.col("low").alias("a"), F.col("node").alias("b")).unionAll(big.filter(F.col("e1") >= NEAR).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    grouped = grouped.filter("a != b").distinct().withColumn("grouped", F.lit(True))
    tested = common.written(grouped, "pairs")
    first = common.written(confirmed(tested, df, id_column, text, k, percent), "confirmed")
    near = first.filter("novel IS NOT NULL").select(F.col("a").alias("h"), F.col("b").alias("x"), F.col("nb").alias("n"), "both", "novel")
    # A third hub for groups: the member that covers most of what the group has in common.
    counted = near.select("h", "x", "n", "both", F.explode_outer("novel").alias("g"))
    counted = counted.join(counted.filter("g IS NOT NULL").groupBy("h", "g").agg(F.count("*").alias("m")).join(near.groupBy("h").agg(F.count("*").alias("members")), "h").filter(F.col("m") >= _enough(F.col("members"))), ["h", "g"], "left")
    central = counted.groupBy("h", "x").agg((F.max("both") * 2 + F.count("m") * 2 - F.max("n")).alias("inner"))
    central = central.groupBy("h").agg(F.max_by("x", F.struct("inner", "x")).alias("hub"), F.count("*").alias("m")).filter("m > 2")
    star = near.join(central, "h").select(F.col("hub").alias("y"), "x").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    star = star.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    star = common.written(_with_sketches(star, small).filter(_likely("p", "q", percent)).select("a", "b", F.lit(False).alias("grouped")), "pairs")
    links = first.filter("link").select("a", "b").unionAll(common.written(confirmed(star, df, id_column, text, k, percent).filter("link").select("a", "b"), "links"))
    found = common.written(connected(links), "components")
    across = _across(tested.select("a", "b").unionAll(star.select("a", "b")), near, big, found, small, percent)
    across = common.written(across.withColumn("grouped", F.lit(False)), "pairs")
    if not across.isEmpty():
        more = common.written(confirmed(across, df, id_column, text, k, percent).filter("link").select("a", "b"), "links")
        if not more.isEmpty():
            found = common.written(connected(links.unionAll(more)), "components")
    whole = nodes.select("k1", "k2", "n", "node").join(found, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component"))
    out = rows.select("id", "n", "k1", "k2").join(whole, ["k1", "k2", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classes(docs)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
