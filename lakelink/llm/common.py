"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of one Arrow batch; with long texts a worker then holds tens of MB.
ARROW_ROWS = 512
#: Bytes of text that the numpy kernels take at once (a longer single text goes alone).
CHUNK_BYTES = 1 << 19
#: A run of characters that are not ASCII white space (a regular expression for Java and for DuckDB).
WORD = r"[^\x20\x09-\x0D]+"
M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """The package on the workers, and small Arrow batches: a batch of long texts must fit beside an executor's heap."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of our own only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "lakelink-checkpoints")
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lakelink/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes a query's shuffle files when the query ends, not when the driver happens to collect its plan.
    For queries that write or count; a frame that is collected twice must be made outside."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table that written() made and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/lakelink/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def one_each(docs: DataFrame) -> DataFrame:
    """Rows (id, text) with the least text of each id; as they are where no id repeats (one count of the ids)."""
    if docs.groupBy("id").count().filter("count > 1").isEmpty():
        return docs
    return written(docs.groupBy("id").agg(F.min("text").alias("text")), "documents")


def rows_of(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows."""
    return df.limit(most + 1).count() <= most


def n_words(text: str = "text"):
    """Number of words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and shift rounds)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def chunks(texts):
    """Split a sequence of texts into runs (first, last) of at most CHUNK_BYTES bytes, or a single text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > first and size + n > CHUNK_BYTES:
            yield first, i
            first, size = i, 0
        size += n
    if len(texts) > first:
        yield first, len(texts)


def word_hashes(texts: list[bytes], lower: bool = True):
    """64-bit hashes of the words of all texts, in order, and the offsets of each text's words.

    Words are runs of bytes other than ASCII white space; A-Z are lower-cased if asked for.
    Returns (hashes, offsets, starts, ends): text i has hashes[offsets[i]:offsets[i + 1]];
    starts and ends are byte places in the texts joined by a line feed.
    """
    joined = b"\n".join(texts)
    b = np.frombuffer(joined, np.uint8)
    if lower:
        b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    offsets = np.zeros(len(texts) + 1, np.int64)
    offsets[1:] = np.searchsorted(starts, np.cumsum(lengths) - 1, side="left")
    return hashes, offsets, starts, ends


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words (of one text); with fewer words, of the whole sequence."""
    n = len(hashes)
    if n == 0:
        return hashes[:0]
    width = min(k, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i]
        out ^= out >> np.uint64(29)
    if n < k:
        out += np.uint64(n)
    return mix64(out)


def kept(columns: list[str], new: list[str]) -> list[str]:
    """The columns that stay beside new ones: a column of the same name gives way to the result."""
    taken = {n.lower() for n in new}
    return [c for c in columns if c.lower() not in taken]
