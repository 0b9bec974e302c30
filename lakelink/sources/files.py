"""Reading and writing of entity tables, label lists and results (S1-S21 of the survey)."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
FILES = tuple(f"{split}_source{i}.tsv" for split in ("train", "test") for i in (1, 2, 3)) + ("train_ground_truth.tsv",)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = ENTITY) -> DataFrame:
    """Strict scan: a renamed header or a malformed row is an error; quotes are plain characters."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False).option("quote", "").option("mode", "FAILFAST").csv(path)


def convert(spark: SparkSession, source: str, target: str, schema: T.StructType = ENTITY) -> None:
    """TSV to Parquet with empty strings for nulls."""
    read_tsv(spark, source, schema).na.fill("").write.mode("overwrite").option("compression", "zstd").parquet(target)


def create_view(spark: SparkSession, name: str, path: str, schema: T.StructType = ENTITY) -> None:
    read_tsv(spark, path, schema).createOrReplaceTempView(name)


def find_dataset_files(root: str) -> dict[str, str]:
    """Paths of the seven tables below root; side files of archives don't count, a missing one is an error."""
    found: dict[str, str] = {}
    for p in sorted(Path(root).rglob("*.tsv")):
        if p.name in FILES and not p.name.startswith("._") and "__MACOSX" not in p.parts:
            found.setdefault(p.name, str(p))
    if missing := [n for n in FILES if n not in found]:
        raise FileNotFoundError(f"missing in {root}: {', '.join(missing)}")
    return found


def find_source_zip(root: str) -> str | None:
    """The largest archive that isn't a submission."""
    zips = [p for p in Path(root).rglob("*.zip") if "submission" not in p.name.lower()]
    return str(max(zips, key=lambda p: p.stat().st_size)) if zips else None


def extract_zip(path: str, target: str) -> None:
    with zipfile.ZipFile(path) as z:
        z.extractall(target)


def edges(truth: DataFrame, sid: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """(sid, tid) of a comma list; blanks are dropped, items trimmed."""
    rows = truth.select(F.col(sid).alias("sid"), F.explode(F.split(F.coalesce(F.col(ids), F.lit("")), ",")).alias("tid"))
    return rows.select("sid", F.trim("tid").alias("tid")).filter("tid <> ''")


def match_lists(universe: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row for each entity of the universe: its sorted distinct targets, comma-joined, '' for none."""
    lists = pairs.groupBy("sid").agg(F.array_join(F.array_sort(F.collect_set("tid")), ",").alias(name))
    rows = universe.select(F.col("entity_id").alias("sid")).distinct().join(lists, "sid", "left")
    return rows.select(F.col("sid").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def baseline(universe: DataFrame) -> DataFrame:
    """The valid result without any match."""
    return universe.select(F.col("entity_id").alias("source1_entity_id"), F.lit("").alias("matched_entity_ids")).distinct()


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One TSV file with a header, LF, no quotes; it appears at once or not at all."""
    if df.columns != columns:
        raise ValueError(f"columns {df.columns}, not {columns}")
    temp = f"{path}.parts"
    df.select(F.concat_ws("\t", *columns).alias("value")).coalesce(1).write.mode("overwrite").text(temp)
    part = next(Path(temp).glob("part-*"))
    with open(f"{path}.new", "wb") as out:
        out.write(("\t".join(columns) + "\n").encode())
        with part.open("rb") as f:
            while block := f.read(1 << 20):
                out.write(block)
    os.replace(f"{path}.new", path)
    for p in Path(temp).iterdir():
        p.unlink()
    Path(temp).rmdir()


def package(paths: list[str], target: str) -> None:
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in paths:
            z.write(p, os.path.basename(p))


def read_pairs_csv(spark: SparkSession, path: str, left: str, right: str, label: str) -> DataFrame:
    """Labelled pairs; a label other than 0 and 1 is an error."""
    rows = spark.read.option("header", True).csv(path)
    good = F.when(F.col(label).isin("0", "1"), F.col(label).cast("int")).otherwise(F.raise_error(F.concat(F.lit("bad label: "), F.coalesce(F.col(label), F.lit("null")))))
    return rows.select(F.col(left).alias("sid"), F.col(right).alias("tid"), good.cast("int").alias("label"))


def fingerprint(config: dict, *upstream: str) -> str:
    """Key of a stage's result: all of its configuration and the keys of what it reads."""
    return hashlib.sha256(json.dumps([config, upstream], sort_keys=True).encode()).hexdigest()


class StageCache:
    """Stage results as Parquet with the fingerprint beside them."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def get(self, spark: SparkSession, name: str, key: str, make) -> DataFrame:
        path, meta = self.folder / f"{name}.parquet", self.folder / f"{name}.meta.json"
        if not (path.exists() and meta.exists() and json.loads(meta.read_text()).get("key") == key):
            meta.unlink(missing_ok=True)
            make().write.mode("overwrite").parquet(str(path))
            meta.write_text(json.dumps({"key": key}))
        return spark.read.parquet(str(path))


class StepRunner:
    """Runs commands once: done means ended with 0 under the same command line."""

    def __init__(self, manifest: str):
        self.path = Path(manifest)

    def _read(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def is_done(self, name: str, command: list[str]) -> bool:
        return self._read().get(name) == command

    def pending(self, steps: dict[str, list[str]]) -> list[str]:
        return [n for n, c in steps.items() if not self.is_done(n, c)]

    def run(self, steps: dict[str, list[str]]) -> list[str]:
        ran = []
        for name in self.pending(steps):
            if subprocess.run(steps[name], check=False).returncode:
                raise RuntimeError(f"step {name} failed")
            self.path.write_text(json.dumps(self._read() | {name: steps[name]}))
            ran.append(name)
        return ran
