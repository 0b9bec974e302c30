"""The driver's tables as three-source entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(key: str):
    return F.concat(F.lit("S"), (F.col(key) % 3 + 1).cast("string"), F.lit("-"), F.col(key).cast("string"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: name and brand, type and size as an address, the type's first word as the country."""
    return table(spark, sf_dir, "part").select(
        _id("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", "p_brand").alias("business_name"),
        F.concat_ws(" ", F.col("p_size").cast("string"), "p_type").alias("business_address"), F.substring_index("p_type", " ", 1).alias("country"),
    )


PARTS_SQL = """src AS (SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id, p_name || ' ' || p_brand AS business_name,
  p_size || ' ' || p_type AS business_address, split_part(p_type, ' ', 1) AS country FROM part)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, whole: the first line, the source with all that follows it, the language."""
    first = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.char_length(first) + 2, F.char_length("text"))
    return table(spark, sf_dir, "documents").select(_id("doc_id").alias("entity_id"), first.alias("business_name"), F.concat(F.col("source"), F.lit(" "), rest).alias("business_address"), F.col("lang").alias("country"))


DOCS_SQL = """src AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, split_part(text, chr(10), 1) AS business_name,
  source || ' ' || substr(text, length(split_part(text, chr(10), 1)) + 2) AS business_address, lang AS country FROM documents)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and supplier: S1 customers with even keys, S2 those with odd keys, S3 suppliers; nation as the country."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    a = c.select(F.concat(F.lit("S"), (F.col("c_custkey") % 2 + 1).cast("string"), F.lit("-"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_name").alias("business_name"), F.concat_ws(", ", "c_mktsegment", "n_name").alias("business_address"), F.col("n_name").alias("country"))
    b = s.select(F.concat(F.lit("S3-"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("business_name"), F.col("n_name").alias("business_address"), F.col("n_name").alias("country"))
    return a.unionByName(b)


PEOPLE_SQL = """src AS (SELECT 'S' || (c_custkey % 2 + 1) || '-' || c_custkey AS entity_id, c_name AS business_name, c_mktsegment || ', ' || n_name AS business_address, n_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'S3-' || s_suppkey, s_name, n_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
