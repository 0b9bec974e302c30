"""Arriving target records linked to a static Source 1 index, batch by batch (the batch operators, driven by a stream)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.blocking import key_index, key_records, scored_against, scored_keys
from ..operators.decisions import resolve_conflicts
from ..operators.normalize import normalized


def write_index(source1: DataFrame, path: str) -> None:
    """The key index of Source 1, written once; arrivals are joined to it by key."""
    records = key_records(normalized(source1))
    key_index(scored_keys(records), records).write.mode("overwrite").parquet(path)


def link_arrivals(arrivals: DataFrame, index_path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, top: int = 1):
    """Starts the query: each micro-batch of arrivals becomes its best links (rid, s1, score) and goes to sink."""

    def batch(rows: DataFrame, number: int) -> None:
        index = rows.sparkSession.read.parquet(index_path)
        pairs = scored_against(key_records(normalized(rows)), index, top)
        sink(resolve_conflicts(pairs.withColumnRenamed("bscore", "score")).select("rid", "s1", "score"), number)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
