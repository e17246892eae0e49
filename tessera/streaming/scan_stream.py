"""Scanning of a stream of contents: the batch rules, which keep no state, and windowed counts of what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scan


def findings(stream: DataFrame) -> DataFrame:
    """stream (entity_id, content, ts) -> findings with ts."""
    hits = scan.matched_rules(stream)
    return hits.select("entity_id", "ts", F.explode("rules").alias("rule"))


def counts(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Findings of each rule by tumbling window; rows later than `late` are dropped with their window's state."""
    return findings(stream).withWatermark("ts", late).groupBy(F.window("ts", window), "rule").agg(F.count(F.lit(1)).alias("n"))
