"""URL filters by a sorted digest array.

The rules (host and path prefix, each with a verdict) lie in one index: their 64-bit xxhash keys
sorted in an array that workers memory-map, and the full strings beside it in the same order. A
url's candidates (each host suffix with each path prefix of a length that rules have) are hashed,
probed by vectorised binary search, and a hit counts only if the stored string equals the
candidate, so colliding keys do no harm. Spark hands the index files to executors (addFile); an
executor that joins later fetches them too.

A rule `host/path` fits its host and all subdomains if the url's path starts with `/path`. The
longest fitting rule wins: the longest string, of equal ones the longest host. Without a fitting
rule the filter's default holds: allow, as the array lists all that is blocked.

Defined results: null urls and urls without `://` have empty host and path, no rule and the
default verdict. Repeated rows are judged one by one. An empty rule list gives the default.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
_added: set[tuple[str, str]] = set()
_URL = re.compile(r"(?s)://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty without `://`."""
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def key(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Sorted keys with their strings and verdicts, memory-mapped from a folder of files."""

    def __init__(self, keys: np.ndarray, places: np.ndarray, strings: np.ndarray, verdicts: np.ndarray):
        self.keys, self.places, self.strings, self.verdicts = keys, places, strings, verdicts

    @staticmethod
    def write(folder: str, rules: list[tuple[str, str]], hasher=key) -> list[str]:
        """Write the four files; returns their paths. The first verdict of a repeated rule counts."""
        for r, v in rules:
            if "/" not in r or v not in ("allow", "block"):
                raise ValueError(f"bad rule {r!r}, {v!r}")
        unique: dict[str, str] = {}
        for r, v in rules:
            host, _, path = r.partition("/")
            unique.setdefault(f"{host.translate(_LOWER)}/{path}", v)
        rows = sorted((hasher(r), r, v) for r, v in unique.items())
        blobs = [r.encode("utf-8", "surrogatepass") for _, r, _ in rows]
        arrays = {
            "keys": np.array([k for k, _, _ in rows], np.uint64),
            "places": np.cumsum([0, *map(len, blobs)], dtype=np.int64),
            "strings": np.frombuffer(b"".join(blobs) + b"\0", np.uint8),
            "verdicts": np.array([v == "block" for _, _, v in rows], np.uint8),
        }
        tag = hashlib.sha256(b"".join(a.tobytes() for a in arrays.values())).hexdigest()[:16]
        paths = []
        for name, a in arrays.items():
            path = os.path.join(folder, f"url-rules-{tag}-{name}.npy")
            with open(path, "wb") as f:
                np.save(f, a)
            paths.append(path)
        return paths

    @classmethod
    def open(cls, paths: list[str]) -> DigestArray:
        return cls(*(np.load(p, mmap_mode="r") for p in paths))

    def string(self, i: int) -> str:
        return bytes(self.strings[self.places[i] : self.places[i + 1]]).decode("utf-8", "surrogatepass")

    def find(self, candidates: list[str], hasher=key) -> np.ndarray:
        """The place of each candidate, -1 if it isn't listed."""
        out = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return out
        probes = np.fromiter(map(hasher, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, probes)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probes)
        for i in hit:
            j = at[i]
            while j < len(self.keys) and self.keys[j] == probes[i]:  # keys may collide
                if self.string(j) == candidates[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def lengths(self) -> tuple[set[int], int]:
        """Lengths of the rules' paths (after the slash) and the most labels that a host has."""
        paths, labels = set(), 0
        for i in range(len(self.keys)):
            host, _, path = self.string(i).partition("/")
            paths.add(len(path))
            labels = max(labels, host.count(".") + 1)
        return paths, labels


def judged(df: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict."""
    spark = df.sparkSession
    common.python_ready(spark)
    new = ["host", "path", "rule", "verdict"]
    keep = common.kept(df.columns if keep is None else keep, new)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.StringType()) for c in new])
    paths = DigestArray.write(tempfile.mkdtemp(prefix="url-rules-"), rules)  # the driver's copy; addFile hands it out
    names = [os.path.basename(p) for p in paths]  # with a digest of the rules; a name can be added only once
    for p, name in zip(paths, names, strict=True):
        if (key_ := (spark.sparkContext.applicationId, name)) not in _added:
            spark.sparkContext.addFile(p)
            _added.add(key_)
    lengths, labels = DigestArray.open(paths).lengths()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = DigestArray.open([SparkFiles.get(n) for n in names])
        for frame in frames:
            parts = [split_url(u) for u in frame[url]]
            candidates, owner = [], []
            for i, (host, path) in enumerate(parts):
                if not path.startswith("/"):
                    continue
                dots = [m.start() + 1 for m in re.finditer(r"\.", host)]
                suffixes = [host[d:] for d in ([0, *dots][-labels:] if labels else [])]
                for n in lengths:
                    if n < len(path):
                        for s in suffixes:
                            candidates.append(s + path[: n + 1])
                            owner.append(i)
            found = index.find(candidates)
            best: dict[int, tuple[int, int, int]] = {}
            for c in np.flatnonzero(found >= 0):
                rank = (len(candidates[c]), candidates[c].index("/"), int(found[c]))
                best[owner[c]] = max(best.get(owner[c], rank), rank)
            out = frame[keep].copy()
            out["host"], out["path"] = [p[0] for p in parts], [p[1] for p in parts]
            out["rule"] = [index.string(best[i][2]) if i in best else None for i in range(len(parts))]
            out["verdict"] = [("block" if index.verdicts[best[i][2]] else "allow") if i in best else default for i in range(len(parts))]
            yield out

    return df.mapInPandas(run, schema)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])


def _rules_sql() -> list[tuple[str, str, str]]:
    """Branches of a CASE, the longest rule first."""
    out = []
    for r, v in sorted(RULES, key=lambda x: -len(x[0])):
        host, _, path = r.partition("/")
        out.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", r, v))
    return out


ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path FROM cut)
SELECT page_id, host, path,
    CASE {" ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in _rules_sql())} END AS rule,
    CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, _, v in _rules_sql())} ELSE 'allow' END AS verdict
FROM parts
"""
