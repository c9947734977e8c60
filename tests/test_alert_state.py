"""Alert roll-up against a row-by-row upsert, and the adaptive and resource limiters against simple loops."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetsight.operators import adaptive, alerts, resource_events, rules

START = datetime(2024, 1, 1)
FIXED = {"source_type": "native", "rule_id": None, "rule_name": "R", "system_id": "S", "severity": "ERROR", "escalation_target": None, "metadata": "{}"}
DDL = (
    "alert_key string, source_type string, rule_id bigint, rule_name string, system_id string, hostname string, severity string, "
    "title string, description string, escalation_target string, metadata string, source_event_id bigint, seen_at timestamp"
)


def upsert_loop(events, acks):
    """What a sequential consumer does with one key: bump, refresh, or open a new row."""
    rows, pending = [], sorted(acks)
    for at, event_id in sorted(events):
        while pending and pending[0][0] <= at:
            ack_at, minutes = pending.pop(0)
            if rows:
                rows[-1].update(acked=ack_at, until=ack_at + timedelta(minutes=minutes))
        current = rows[-1] if rows else None
        if current and current["until"] and current["until"] > at:
            current.update(last=at, event=event_id, n=current["n"] + 1)
        elif current and current["acked"] is None:
            current.update(last=at, event=event_id, n=current["n"] + 1, title=f"t{event_id}")
        else:
            rows.append({"first": at, "last": at, "event": event_id, "n": 1, "title": f"t{event_id}", "acked": None, "until": None})
    for ack_at, minutes in pending:
        if rows:
            rows[-1].update(acked=ack_at, until=ack_at + timedelta(minutes=minutes))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_roll_up_with_acks_equals_sequential_upsert(spark, seed):
    rng = random.Random(seed)
    events, acks = {}, {}
    ident = 0
    for k in range(25):
        moments = sorted(rng.sample(range(0, 5000), rng.choice([1, 3, 12, 60])))
        events[f"k{k}"] = [(START + timedelta(minutes=m), ident + i) for i, m in enumerate(moments)]
        ident += len(moments)
        acks[f"k{k}"] = [(START + timedelta(minutes=m, seconds=30), rng.choice([5, 30, 400])) for m in sorted(rng.sample(range(0, 6000), rng.choice([0, 1, 2, 6])))]
    rows = [
        (k, FIXED["source_type"], None, "R", "S", f"h{e}", "ERROR", f"t{e}", "d", None, "{}", e, at) for k, ev in events.items() for at, e in ev
    ]
    log = [(k, at, m) for k, items in acks.items() for at, m in items]
    got = alerts.roll_up_with_acks(spark.createDataFrame(rows, DDL), spark.createDataFrame(log, "alert_key string, acked_at timestamp, cooldown_minutes int"))
    have = {(r.alert_key, r.episode): (r.first_seen_at, r.last_seen_at, r.source_event_id, r.occurrence_count, r.title, r.acknowledged_at, r.suppressed_until) for r in got.collect()}
    want = {
        (k, i): (x["first"], x["last"], x["event"], x["n"], x["title"], x["acked"], x["until"])
        for k in events
        for i, x in enumerate(upsert_loop(events[k], acks[k]), 1)
    }
    assert have == want


def test_roll_up_without_acks_equals_empty_log(spark, tables):
    rows = alerts.native_candidates(tables.tel)
    plain = alerts.roll_up(rows).select("alert_key", "occurrence_count", "first_seen_at", "last_seen_at", "title")
    empty = spark.createDataFrame([], "alert_key string, acked_at timestamp")
    logged = alerts.roll_up_with_acks(rows, empty).select("alert_key", "occurrence_count", "first_seen_at", "last_seen_at", "title")
    assert sorted(plain.collect()) == sorted(logged.collect())


def test_rolling_resolution_equals_fold(spark):
    rng = random.Random(3)
    log, want = [], {}
    for rule, n in (("a", 1), ("b", 7), ("c", 400), ("zero", 3)):
        value = 0.0
        for i in range(n):
            x = 0.0 if rule == "zero" or (rule == "b" and i in (0, 3)) else float(rng.randint(1, 10_000))
            value = x if value == 0 else (value + x) / 2
            log.append((rule, x, START + timedelta(minutes=37 * i), i))
        want[rule] = value
    df = spark.createDataFrame(log, "rule string, resolution_time_ms double, resolved_at timestamp, incident_id bigint")
    got = {r["rule"]: r["avg_resolution_ms"] for r in adaptive.rolling_resolution(df).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_unseen_rule_is_boosted(spark):
    rows = spark.createDataFrame([("k", "R", "WARNING", START)], "alert_key string, rule_name string, severity string, seen_at timestamp")
    r = adaptive.adaptive_severity(rows, adaptive.rule_history(rows, START), START).first()
    assert (r.severity_delta, r.adaptive_severity, r.suppression_count) == ("boosted", "ERROR", 0)


def test_slow_rule_is_never_suppressed(spark):
    rows = spark.createDataFrame([(f"k{i}", "R", "ERROR", START - timedelta(seconds=i + 1)) for i in range(9)], "alert_key string, rule_name string, severity string, seen_at timestamp")
    history = adaptive.rule_history(rows, START)
    slow = spark.createDataFrame([("R", 31 * 60_000.0)], "rule string, avg_resolution_ms double")
    assert {r.severity_delta for r in adaptive.adaptive_severity(rows, history, START).collect()} == {"suppressed"}
    assert {r.severity_delta for r in adaptive.adaptive_severity(rows, history, START, slow).collect()} == {"nominal"}


def test_rate_limit_equals_loop(spark):
    rng = random.Random(5)
    rows = [(f"h{rng.randint(0, 6)}", START + timedelta(seconds=rng.randint(0, 4000)), i, f"x{rng.randint(0, 60)}", "m") for i in range(1500)]
    got = {r["tie"] for r in resource_events.rate_limited(spark.createDataFrame(rows, resource_events.CANDIDATE), 30).collect()}
    want = set()
    for host in {r[0] for r in rows}:
        last, seen = None, OrderedDict()
        for _, at, tie, value_hash, _ in sorted((r for r in rows if r[0] == host), key=lambda r: (r[1], r[2])):
            if (last is None or (at - last).total_seconds() >= 30) and value_hash not in seen:
                seen[value_hash] = None
                last = at
                want.add(tie)
    assert got == want


def test_new_rule_defaults(spark):
    df = spark.createDataFrame([("r", 0, " ")], "rule_name string, cooldown_minutes int, escalation_target string")
    r = alerts.new_rule(df).first()
    assert (r.cooldown_minutes, r.escalation_target, r.enabled) == (1, None, True)


def test_live_fields_only_blocks_hidden_columns(spark, tables):
    from fleetsight.operators import rules

    only = spark.createDataFrame([(1, "n", "hostname contains host", "ERROR", 1, 30, None, True)], tables.rules.schema)
    keep = ["id", "system_id", "hostname", "severity", "fault_type", "ingested_at"]
    matched = rules.match_rules(tables.tel, only, keep)
    assert rules.firing_matches(matched, 3600).count() > 0
    assert rules.firing_matches(matched, 3600, live_fields_only=True).count() == 0


def test_rules_without_parsable_condition(spark, tables):
    from fleetsight.operators import rules

    none = tables.rules.filter(F.col("id") == 7)
    assert rules.match_rules(tables.tel, none, ["id"]).count() == 0


def test_many_rules_join_in_salted_parts(tables, monkeypatch):
    """Without a broadcast the same pairs come out, and no field's events go to one task."""
    events = tables.tel.withColumn("normalized_message", F.lower("event_message"))
    want = sorted(map(tuple, rules.match_rules(events, tables.rules, ["id"]).select("rule_id", "id", "actual").collect()))
    monkeypatch.setattr(rules, "BROADCAST_RULES", 1)
    salted = rules.match_rules(events, tables.rules, ["id"])
    assert sorted(map(tuple, salted.select("rule_id", "id", "actual").collect())) == want
    assert "__part" in salted._jdf.queryExecution().optimizedPlan().toString()


CASES = [
    (1, "50", "Disk ", '{"k": "A", "n": 5.0}'),
    (2, "50.0", "disk", '{"k": "a", "n": "5"}'),
    (3, "-0.0", "DISK full", '{"n": -0.0, "other": 1}'),
    (4, "NaN", "nan", '{"k": "NaN", "k2": null}'),
    (5, None, "", None),
    (6, "1e2", "100", "[1]"),
]
CONDITIONS = [
    "cpu = 50", "cpu == 50.00", "cpu = 0", "cpu = -0", "cpu = nan", "cpu = 100", "cpu = 1E2", "cpu != 50", "cpu >= 50", "fault_type = disk",
    "fault_type = 'DISK'", "fault_type contains dis", "fault_type = 1e2", "k = a", "k != a", "n = 5", "n = 0", "n < 5", "k = nan", "other = 1.0", "gone = 1",
]


@pytest.mark.parametrize("broadcast", [20_000, 1])
@pytest.mark.parametrize("named", [1_000, 0])
@pytest.mark.parametrize("fixed", [True, False])
def test_rule_lookups_equal_all_pairs(spark, tables, monkeypatch, broadcast, named, fixed):
    """Rules looked up by value match what every rule tried on every event matches, each pair once."""
    events = spark.createDataFrame(CASES, "id int, cpu_usage_percent string, fault_type string, diagnostic_context string")
    rows = [(i, "n", text, "ERROR", 1, 30, None, True) for i, text in enumerate(CONDITIONS)]
    table = spark.createDataFrame(rows, tables.rules.schema)
    monkeypatch.setattr(rules, "BROADCAST_RULES", broadcast)
    monkeypatch.setattr(rules, "NAMED_KEYS", named)
    got = sorted(tuple(r) for r in rules.match_rules(events, table, ["id"], fix_double_equals=fixed).select("rule_id", "id").collect())
    want = []
    for r in rules.parse_rules(table, fixed).collect():
        actual = rules.context_value(events, r.field)
        hits = events.filter(actual.isNotNull() & rules.condition_holds(actual, F.lit(r.op), F.lit(r.expected)))
        want += [(r.id, e.id) for e in hits.collect()]
    assert got == sorted(want) and len(want) > 20


def test_many_equality_rules_meet_only_their_values(spark, tables):
    """10,000 equality rules on one field: the join hands on matches, not rules times events."""
    events = tables.tel.select("id", F.col("id").cast("string").alias("hostname"))
    table = spark.range(10_000).select(
        F.col("id").cast("int").alias("id"), F.lit("n").alias("rule_name"), F.concat(F.lit("hostname = "), F.col("id")).alias("condition"),
        F.lit("ERROR").alias("severity"), F.lit(1).alias("threshold"),
    )
    matched = rules.match_rules(events, table, ["id"])
    assert "__lookup" in [line for line in matched._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line][0]
    assert matched.count() == events.filter(F.col("id") < 10_000).count()
