"""From raw documents to training tokens: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
the documents; columns beyond the known ones pass through. Missing rows, nulls, empty texts,
repeated rows and ids have the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelink.llm import bpe, common, minhash, mixing, pii, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below its threshold) go."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model, score="__quality")
    return scored.filter(F.col("__quality") >= quality.THRESHOLD).select(*(f"`{c}`" for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least doc_id; of rows of an equal
    doc_id the one with the least text. Rows without a doc_id stay. Shingles of five words, similarity 0.8."""
    found = minhash.classes(docs, k=5, percent=80)
    gone = common.written(found.filter("component_id < id").select(F.col("id").alias("__id")).distinct(), "gone")
    again = common.written(found.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select(F.col("id").alias("__id")), "again")

    def bounded(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= minhash.BROADCAST_IDS else ids

    names = [f"`{c}`" for c in docs.columns]
    left = docs.withColumn("__id", F.col("doc_id").cast("long")).join(bounded(gone), "__id", "left_anti")
    if again.isEmpty():
        return left.select(*names)
    few = bounded(again)
    first = F.row_number().over(Window.partitionBy("__id").orderBy(F.col("text").asc_nulls_last()))
    one = left.join(few, "__id", "left_semi").withColumn("__n", first).filter("__n = 1")
    return left.join(few, "__id", "left_anti").select(*names).unionAll(one.select(*names))


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), n).otherwise(F.col("n_chars")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates in every document."""
    return _with_length(pii.surrogates(docs, n_entities=None, kinds=None)).select(*(f"`{c}`" for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each round that takes words of a document, cut to the words taken (only the
    last document that a source gives in a round is cut)."""
    keys = {"__k1": F.xxhash64("doc_id", "source", "text"), "__k2": F.xxhash64(F.lit(1), "text", "source", "doc_id")}
    slim = common.written(docs.select("doc_id", "source", common.n_words().alias("size"), *(c.alias(n) for n, c in keys.items())), "mix-sizes")
    takes = mixing.mixed(slim).select("__k1", "__k2", "size", "taken_first", "taken_second")
    # Rows with equal keys are equal in all that counts; any of them gets any of their shares.
    share = F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy(F.desc("taken_first"), F.desc("taken_second")))
    takes = takes.withColumn("__n", share).filter("taken_first + taken_second > 0")
    rows = docs.withColumns(keys).withColumn("__n", F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy("doc_id")))
    rows = rows.join(takes.withColumnRenamed("size", "__size"), ["__k1", "__k2", "__n"])
    rows = rows.withColumn("__taken", F.explode(F.filter(F.array("taken_first", "taken_second"), lambda t: t > 0)))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + common.WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("__taken").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("__taken") < F.col("__size"), cut).otherwise(F.col("text")))
    return _with_length(rows.select(*(f"`{c}`" for c in docs.columns)))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their number and the SHA-256 of the decoded text."""
    return bpe.encoded(docs, bpe.vocabulary_path(), ids="token_ids", decoded=None, count="n_tokens", decoded_digest="decoded_sha256")


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{name}")
    return docs
