"""Severities and the three ways in which they are rolled up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("HIGH", "MEDIUM", "LOW", "INFO", "SAFE", "UNKNOWN")
RANK = {"HIGH": 5, "MEDIUM": 4, "LOW": 3, "INFO": 2, "SAFE": 1}


def normalized(c: Column) -> Column:
    """Upper case; whatever is none of the six levels is UNKNOWN."""
    return F.when(F.upper(c).isin(*LEVELS), F.upper(c)).otherwise(F.lit("UNKNOWN"))


def rank(c: Column) -> Column:
    out = F.lit(0)
    for level, r in RANK.items():
        out = F.when(F.upper(c) == level, r).otherwise(out)
    return out


def level(r: Column) -> Column:
    out = F.lit("UNKNOWN")
    for name, k in RANK.items():
        out = F.when(r == k, F.lit(name)).otherwise(out)
    return out


def highest(c: Column) -> Column:
    """Aggregate: the most severe level, UNKNOWN only where there is no concrete one."""
    return level(F.max(rank(c)))


def ladder(c: Column) -> Column:
    """Aggregate of the JSON rows: only HIGH, MEDIUM and LOW displace SAFE."""
    r = F.max(F.when(F.upper(c).isin("HIGH", "MEDIUM", "LOW"), rank(c)).otherwise(1))
    return level(F.coalesce(r, F.lit(1)))


def first_highest(c: Column, seq: Column) -> Column:
    """Aggregate of behavioural rows: INFO, SAFE and UNKNOWN rank alike, and the first of the most severe wins."""
    r = F.when(F.upper(c).isin("HIGH", "MEDIUM", "LOW"), rank(c)).otherwise(0)
    return F.max_by(F.upper(c), F.struct(r, -seq))
