"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from fleetsight.plans import q_alerts, q_fleet, q_ingest, q_intel, q_metrics, q_stream, q_text  # noqa: F401
from fleetsight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
