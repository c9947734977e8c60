"""Feature statistics and report counters on edge rows."""

from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from fleetsight.operators import features, report

NOW = datetime(2024, 1, 1, 12)
DDL = "id bigint, system_id string, severity string, fault_type string, confidence_score decimal(3,2), ingested_at timestamp"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, "a", "CRITICAL", "Z", Decimal("0.90"), NOW),
        (2, "a", "ERROR", "B", None, NOW - timedelta(seconds=29)),
        (3, "a", "INFO", "Z", Decimal("0.10"), NOW - timedelta(seconds=30)),  # exactly on the open bound: outside
        (4, "b", "WARNING", None, Decimal("0.00"), NOW),
    ]
    return spark.createDataFrame(rows, DDL)


def test_tie_takes_the_smaller_name_and_bound_is_open(events):
    r = features.feature_stats(events, NOW).filter("system_id = 'a'").first()
    assert (r.total_events, r.critical_count, r.error_count, r.info_count) == (2, 1, 1, 0)
    assert r.dominant_fault_type == "B" and r.avg_confidence == Decimal("0.55")


def test_missing_fault_is_none(events):
    r = features.feature_stats(events, NOW).filter("system_id = 'b'").first()
    assert (r.dominant_fault_type, r.avg_confidence) == ("NONE", Decimal("0.00"))


def test_silent_host_gets_zeros(events):
    r = features.host_feature_stats(events, "nobody", NOW).first()
    assert (r.total_events, r.warning_count, r.dominant_fault_type, r.avg_confidence) == (0, 0, "NONE", Decimal("0.20"))


def test_many_hosts_zero_filled(spark, events):
    hosts = spark.range(1000).selectExpr("concat('h', id) AS system_id", "cast(1 AS decimal(5,2)) AS cpu_usage_percent")
    rows = features.snapshot_cycle(hosts, events, NOW)
    assert rows.count() == 1000
    r = rows.first()
    assert (r.total_events, r.dominant_fault_type, r.disk_free_percent) == (0, "NONE", Decimal("100.00"))


def test_report_counters_are_those_of_plain_counting(spark, monkeypatch):
    """Positions, cuts and percents with many ties, a null value and more parts than values."""
    monkeypatch.setattr(report, "PARTS", 5)
    rows = []
    for k in range(600):
        provider = None if k % 97 == 0 else f"p{k % 45 if k % 3 else k % 7}"
        rows.append((k, datetime(2024, 1, 1) + timedelta(seconds=k), f"c{k % 2}", k % 5, None if k % 4 else f"f{k % 40}", provider, (k * k) % 61))
    ddl = "id long, ingested_at timestamp, log_channel string, level int, fault_type string, provider_name string, event_code int"
    got = {(r.dimension, r.value): (r.position, r["count"], r.percent) for r in report.report_counters(spark.createDataFrame(rows, ddl), {"provider": 4, "event_code": 9}).collect()}
    want = {}
    for dimension, at, keep in (("channel", 2, None), ("level", 3, None), ("fault", 4, None), ("provider", 5, 4), ("event_code", 6, 9)):
        values = Counter(("UNKNOWN" if dimension == "fault" and r[at] is None else None if r[at] is None else str(r[at])) for r in rows)
        ranked = sorted(values.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
        want |= {(dimension, v): (i, n, round(n * 100 / len(rows) + 1e-9, 1)) for i, (v, n) in enumerate(ranked[:keep], 1)}
    assert got == want
