"""Telemetry tables derived from the star-schema ``events`` table."""

from __future__ import annotations

import os
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.functions.ordered import latest_per_key
from fleetsight.operators import features, scoring
from fleetsight.schemas import RAW_EVENTS
from fleetsight.session import prepare

DAY = 24 * 3600

# What each event type of the star schema stands for.
EVENT_KINDS = [
    ("error", "Service Control Manager", 7031, "SERVICE_ERROR"),
    ("purchase", "Microsoft-Windows-Kernel-Processor-Power", 37, "RESOURCE_WARNING"),
    ("signup", "Microsoft-Windows-DistributedCOM", 10016, "SECURITY_EVENT"),
    ("view", "Netwtw14", 5002, "DRIVER_ISSUE"),
]

# A rule set that covers numeric, text, JSON-key, malformed and double-equals conditions.
SAMPLE_RULES = [
    (1, "High CPU", "cpu > 90", "CRITICAL", 1, 30, None, True),
    (2, "Low disk", "disk <= 10", "WARNING", 2, 60, "ops@example.org", True),
    (3, "Service errors", "fault_type = SERVICE_ERROR", "ERROR", 3, 30, None, True),
    (4, "Text", "message contains purchase", "WARNING", 1, 15, None, True),
    (5, "Diag key", "k >= 95", "ERROR", 1, 30, "noc@example.org", True),
    (6, "Double equals quirk", "cpu == 50", "ERROR", 1, 30, None, True),
    (7, "Malformed", "cpu above 9", "ERROR", 1, 30, None, True),
    (8, "Disabled", "cpu > 1", "ERROR", 1, 30, None, False),
]
RULES_DDL = (
    "id bigint, rule_name string, condition string, severity string, threshold int, cooldown_minutes int, "
    "escalation_target string, enabled boolean"
)


def _by_kind(position: int, otherwise: str) -> str:
    whens = " ".join(f"WHEN '{k[0]}' THEN {k[position]!r}" for k in EVENT_KINDS)
    return f"CASE event_type {whens} ELSE {otherwise} END"


READING = "try_cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 101"
SEVERITY = (
    "CASE WHEN event_type = 'error' AND value >= 20 THEN {0} WHEN event_type = 'error' THEN {1} "
    "WHEN event_type IN ('purchase', 'signup') THEN {2} ELSE {3} END"
)


def telemetry(raw: DataFrame) -> DataFrame:
    """One narrow projection: no shuffle, and filters on ``ingested_at`` reach the scan as filters on ``ts``."""
    return raw.selectExpr(
        "event_id AS id",
        "concat('SYS-', lpad(cast(user_id AS string), 4, '0')) AS system_id",
        "CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('host-', cast(user_id % 40 AS string)) END AS hostname",
        "'System' AS log_channel",
        f"{_by_kind(1, "'App-Host'")} AS provider_name",
        f"{_by_kind(2, '1000')} AS event_code",
        f"{SEVERITY.format("'CRITICAL'", "'ERROR'", "'WARNING'", "'INFO'")} AS severity",
        f"{SEVERITY.format(1, 2, 3, 4)} AS level",
        f"{_by_kind(3, "'UNKNOWN'")} AS fault_type",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('sub', cast(event_id % 3 AS string)) END AS fault_subtype",
        "cast(least(value, 100D) AS decimal(5,2)) AS cpu_usage_percent",
        f"cast({READING} AS decimal(5,2)) AS memory_usage_percent",
        f"cast(100 - {READING} AS decimal(5,2)) AS disk_free_percent",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE cast(cast(event_id % 100 AS decimal(5,2)) / 100 AS decimal(3,2)) END AS confidence_score",
        "props AS diagnostic_context",
        "concat(event_type, ' on user ', cast(user_id AS string)) AS event_message",
        "ts AS ingested_at",
    )


def heartbeats(tel: DataFrame) -> DataFrame:
    """Newest event of every host that reports a name (hosts without one exercise the left-join defaults)."""
    named = tel.filter(F.col("hostname") != "")
    newest = latest_per_key(named, ["system_id"], F.col("ingested_at").desc(), F.col("id").desc())
    return newest.select(
        "system_id",
        "hostname",
        "cpu_usage_percent",
        "memory_usage_percent",
        "disk_free_percent",
        F.col("ingested_at").alias("last_seen"),
    )


class Tables:
    """Lazy access to the tables under one directory; every plan is built once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir
        self._snaps: dict[int, DataFrame] = {}
        self._preds: dict[int, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet"))

    @cached_property
    def raw_events(self) -> DataFrame:
        return self.spark.read.schema(RAW_EVENTS).parquet(os.path.join(self.dir, "events.parquet"))

    @cached_property
    def as_of(self) -> datetime:
        """Newest event time. One number is brought to the driver so that windows are literals and prune the scan."""
        text = self.raw_events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        return datetime.strptime(text, "%Y-%m-%d %H:%M:%S.%f")

    @cached_property
    def tel(self) -> DataFrame:
        return telemetry(self.raw_events)

    @cached_property
    def hb(self) -> DataFrame:
        return heartbeats(self.tel)

    def snaps(self, window_seconds: int = DAY) -> DataFrame:
        """Feature snapshots, one per host and tumbling window."""
        if window_seconds not in self._snaps:
            self._snaps[window_seconds] = features.windowed_snapshots(self.tel, window_seconds)
        return self._snaps[window_seconds]

    def preds(self, window_seconds: int = DAY) -> DataFrame:
        """Heuristic predictions, one per snapshot."""
        if window_seconds not in self._preds:
            self._preds[window_seconds] = scoring.heuristic_predictions(self.snaps(window_seconds))
        return self._preds[window_seconds]

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(SAMPLE_RULES, RULES_DDL)
