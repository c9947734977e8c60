"""Severity names, ranks and steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsight.schemas import LEVEL_NAMES, SEVERITIES


def severity_rank(c: Column) -> Column:
    """INFO 1, WARNING 2, ERROR 3, CRITICAL 4; anything else 0."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c), F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


def step_severity(c: Column, direction: int) -> Column:
    """One step up (+1) or down (-1), stopping at INFO and CRITICAL."""
    return severity_name(F.greatest(F.lit(1), F.least(F.lit(len(SEVERITIES)), severity_rank(c) + F.lit(direction))))


def level_name(level: Column, default: Column | None = None) -> Column:
    expr = None
    for number, name in LEVEL_NAMES.items():
        expr = F.when(level == number, name) if expr is None else expr.when(level == number, name)
    return expr.otherwise(F.concat(F.lit("LEVEL_"), level.cast("string")) if default is None else default)


def tier(c: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """First label whose lower bound is reached."""
    expr = None
    for bound, label in steps:
        expr = F.when(c >= bound, label) if expr is None else expr.when(c >= bound, label)
    return expr.otherwise(rest)


# Score bands.
def anomaly_tier(score: Column) -> Column:
    return tier(score, [(0.75, "CRITICAL"), (0.50, "HIGH"), (0.30, "MEDIUM")], "LOW")


def health_tier(score: Column) -> Column:
    return tier(score, [(85, "NOMINAL"), (60, "DEGRADED"), (30, "IMPAIRED")], "CRITICAL")


def event_health_level(score: Column) -> Column:
    return tier(score, [(10, "critical"), (5, "error"), (2, "warning")], "healthy")
