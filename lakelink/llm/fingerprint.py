"""Document fingerprints by order min-hashing, in DataFrame functions only.

A text is cut into pieces (words, long ones in parts), its k-mers are pairs of neighbouring pieces,
and equal k-mers are told apart by their occurrence number. Each of PERMUTATIONS orders selects the two
least (k-mer, occurrence) elements; they are put in the order of their places in the text and
hashed as a tuple, so the signature feels moved as well as changed passages. The likeness of two
fingerprints is the share of equal tuples.

One 64-bit hash h of an element gives all orders: order j ranks elements by h xor j * 2**58, so each
order has its own zone of hash values as the least, then the neighbouring zones. Hence the two
least elements of each zone suffice for all orders, in texts of any length: one permutation cut in
zones stands for independent ones, which would take as many hashes of each element.

The next document's text comes by one shuffle: documents go to ranges of doc_id (buckets), the
first document of a range also to the range before it, as its tail. All later windows and groups are
within a bucket and reuse that partitioning.

Defined results: null texts are empty; an empty text has the fingerprint of no elements. Null doc_ids
come last, rows of equal doc_id in the order of their texts. A single document is its own next. Extra
columns are not read. Places beyond 2**23 pieces wrap when two elements are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PERMUTATIONS = 32
PIECE = r"[^\x20\x09-\x0D]{1,12}"
PLACE_BITS, HASH_BITS = 23, 40
#: Partitions for each of the session's shuffle partitions: exploded k-mers need small ones.
FINER, BUCKETS_PER_PARTITION = 4, 1


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bucket_of(k: Column, bounds: list[int]) -> Column:
    """The last bound that isn't above k, by binary search in nested conditions."""

    def within(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(k < F.lit(bounds[mid]).cast("long"), within(lo, mid)).otherwise(within(mid, hi))

    return within(0, len(bounds))


def _tuples(elements: Column) -> Column:
    """The signature of an array of packed elements (hash above, place below)."""
    place = F.lit((1 << PLACE_BITS) - 1).cast("long")
    zone_shift = PLACE_BITS + HASH_BITS - 5

    def one(j: Column) -> Column:
        flip = F.shiftleft(j.cast("long"), zone_shift)

        def pick(order: Column) -> Column:
            a, b = F.get(order, F.lit(0)).bitwiseXOR(flip), F.coalesce(F.get(order, F.lit(1)), F.get(order, F.lit(0))).bitwiseXOR(flip)
            first = a.bitwiseAND(place) <= b.bitwiseAND(place)
            x, y = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
            return F.xxhash64(j, F.shiftright(x, PLACE_BITS), F.shiftright(y, PLACE_BITS)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

        return _let(F.sort_array(F.transform(elements, lambda x: x.bitwiseXOR(flip))), pick)

    none = F.array_repeat(F.lit(0).cast("long"), PERMUTATIONS)
    return F.when(F.size(elements) > 0, F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1)), one)).otherwise(none)


def _joined(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.lit(float(PERMUTATIONS))


def _signed(rows: DataFrame, by: list[str], texts: dict[str, Column], keep: dict[str, Column]) -> DataFrame:
    """A row for each row of rows: the by columns, the struct `kept` of keep, and a signature named after each text.

    rows must be dealt out by some of the by columns; nothing here deals them out again."""
    pieces = lambda t: F.transform(F.regexp_extract_all(t, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x))
    kinds = F.filter(F.array(*(F.struct(F.lit(i).alias("kind"), t.alias("text")) for i, t in enumerate(texts.values()))), lambda x: x["text"].isNotNull())
    rows = rows.select(*by, F.struct(*(c.alias(n) for n, c in keep.items())).alias("kept"), F.explode(kinds).alias("x"))
    rows = rows.select(*by, "kept", F.col("x.kind").alias("kind"), pieces(F.col("x.text")).alias("w"))
    rows = rows.select(*by, "kept", "kind", F.size("w").alias("n"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("pos", "pair"))
    # What is kept rides on the first k-mer only.
    kmers = rows.select(*by, "kind", "n", "pos", F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("kept")).alias("kept"), F.xxhash64("pair.a", "pair.b").alias("kmer"))
    occurrence = F.row_number().over(Window.partitionBy("kmer", *by, "kind").orderBy("pos"))
    kmers = kmers.withColumn("h", F.shiftrightunsigned(F.xxhash64("kmer", occurrence), 64 - HASH_BITS))
    packed = F.shiftleft("h", PLACE_BITS).bitwiseOR(F.col("pos").cast("long").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")))
    kmers = kmers.select(*by, "kind", "kept", F.when(F.col("pos").isNotNull(), packed).alias("e"))
    chosen = [F.collect_list(F.when(F.col("kind") == i, F.col("e"))).alias(f"__{n}") for i, n in enumerate(texts)]
    out = kmers.groupBy(*by).agg(F.max("kept").alias("kept"), *chosen)
    # Each array is made once a row; as plain expressions they would be copied into the lambdas.
    signature = lambda c: _let(F.sort_array(c), lambda e: _let(_two_of_each_zone(e), _tuples))
    return out.select(*by, "kept", *(signature(F.col(f"__{n}")).alias(n) for n in texts))


def _two_of_each_zone(elements: Column) -> Column:
    """The two least elements of each zone of a sorted array."""
    zone = lambda e: F.shiftright(e, PLACE_BITS + HASH_BITS - 5)
    return F.filter(elements, lambda e, i: F.coalesce(zone(F.get(elements, i - 2)) != zone(e), F.lit(True)))


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text: the last floor(n_chars / 4) characters replaced by the first as many (or all) of the next row's."""
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("id", F.lit((1 << 63) - 1)))
    parts = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = BUCKETS_PER_PARTITION * parts
    # n values at most, from one pass over the ids; the least id is the first of them.
    found = rows.agg(F.min("k").alias("least"), F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n).alias("at")).collect()[0]
    bounds = sorted({found["least"], *found["at"]}) if found["least"] is not None else [0]
    rows = rows.withColumn("b", _bucket_of(F.col("k"), bounds))
    first = F.col("k") == F.element_at(F.array(*(F.lit(x).cast("long") for x in bounds)), F.col("b") + 1)
    before = F.pmod(F.col("b") - 1, F.lit(len(bounds)))
    own, tail = F.struct(F.col("b").alias("b"), F.lit(0).alias("tail")), F.struct(before.alias("b"), F.lit(1).alias("tail"))
    rows = rows.withColumn("to", F.explode(F.when(first, F.array(own, tail)).otherwise(F.array(own)))).select("id", "k", "text", F.col("to.b").alias("b"), F.col("to.tail").alias("tail"))
    rows = rows.repartition(parts, "b")
    order = Window.partitionBy("b").orderBy("tail", "k", "text")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("rn", F.row_number().over(order))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.when(F.col("tail") == 0, F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next"), F.lit(1), cut)))
    rows = rows.withColumn("edited", edited)
    keep = {"id": F.col("id"), "n_chars": F.col("n_chars"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "tail": F.col("tail")}
    signed = _signed(rows, ["b", "rn"], {"own": F.col("text"), "changed": F.col("edited")}, keep)
    signed = signed.withColumn("next", F.lead("own").over(Window.partitionBy("b").orderBy("rn"))).filter("kept.tail = 0")
    return signed.select(
        F.col("kept.id").alias(id_column), F.col("kept.n_chars").alias("n_chars"), F.col("kept.edited_sha256").alias("edited_sha256"),
        _joined(F.col("own")).alias("fingerprint"), _joined(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
