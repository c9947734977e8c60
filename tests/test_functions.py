"""Column functions on small literals: the documented cases and their edges."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetsight.functions import clock, coerce, severity, text, xml
from fleetsight.operators import classify, rules, shaping


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want",
    [
        (None, ""),
        ("", ""),
        ("<b>hi</b>", "hi"),
        ("<a><b>x</b></a> y", "x y"),
        ("a\t\n  b", "a b"),
        ("a  b", "a b"),
        ("<only><tags/>", ""),
        ("é" * 600, "é" * 500),
        ("a < b > c", "a c"),
    ],
)
def test_clean_message(spark, raw, want):
    assert one(spark, text.clean_message(F.lit(raw).cast("string"))) == want


def test_clean_message_zero_length(spark):
    assert one(spark, text.clean_message(F.lit("abc"), 0)) == ""


@pytest.mark.parametrize("body", ["a" * 10, "é" * 10, "€" * 10, "😀" * 10, "aé€😀" * 4, ""])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 9, 100])
def test_truncate_utf8(spark, body, n):
    assert one(spark, text.truncate_utf8(F.lit(body), n)) == body.encode()[:n].decode(errors="ignore")


@pytest.mark.parametrize("raw,as_int,as_float", [("7", 7, 7.0), (" 8 ", 8, 8.0), ("7.9", -1, 7.9), ("5d", -1, 0.5), ("x", -1, 0.5), (None, -1, 0.5), ("1e3", -1, 1000.0), ("\t9\u2003", 9, 9.0), ("9\n9", -1, 0.5), ("-.5", -1, -0.5), ("", -1, 0.5)])
def test_number_text(spark, raw, as_int, as_float):
    c = F.lit(raw).cast("string")
    assert one(spark, coerce.int_or(c, -1, is_text=True)) == as_int
    assert one(spark, coerce.float_or(c, 0.5, is_text=True)) == as_float


@pytest.mark.parametrize("given,want", [(5, 5), (0, 1), (5000, 5000), ("bad", 100), (None, 100), ("7", 7)])
def test_bounded_limit(given, want):
    assert coerce.bounded_limit(given) == want


@pytest.mark.parametrize("raw", [" a\tb ", "\ta b\n", "\u00a0x\u3000", "\x1c\x1dy\x85", "\u200bz", "", " \t"])
def test_strip_is_unicode_aware(spark, raw):
    assert one(spark, coerce.strip(F.lit(raw))) == raw.strip()


def test_text_or_keeps_blank(spark):
    assert one(spark, coerce.text_or(F.lit("  "), "f")) == ""
    assert one(spark, coerce.text_or(F.lit(None).cast("string"), "f")) == "f"


@pytest.mark.parametrize("seconds,want", [(0, "now"), (29, "now"), (30, "1m ago"), (3540, "59m ago"), (3600, "1h ago"), (7199, "2h ago")])
def test_age_label(spark, seconds, want):
    assert one(spark, clock.age_label(F.lit(float(seconds)))) == want


@pytest.mark.parametrize("seconds,want", [(10, "< 1 min"), (30, "~1 min"), (719, "~12 min"), (3600, "~1h"), (3900, "~1h 5m")])
def test_duration_label(spark, seconds, want):
    assert one(spark, clock.duration_label(F.lit(float(seconds)))) == want


@pytest.mark.parametrize("seconds,want", [(59, "now"), (60, "1m"), (3600, "1h"), (86400, "1d")])
def test_short_age(spark, seconds, want):
    assert one(spark, clock.short_age_label(F.lit(float(seconds)))) == want


def test_month_shift(spark):
    c = clock.at(datetime(2024, 12, 15, 3))
    assert one(spark, clock.shift_month(c, 1).cast("string")) == "2025-01-01 00:00:00"


def test_windows_differ_at_the_edge(spark):
    now = datetime(2024, 1, 1, 12)
    edge = clock.at(now - timedelta(minutes=5))
    assert one(spark, clock.in_window(edge, now, 300)) is False
    assert one(spark, clock.in_window(edge, now, 300, inclusive=True)) is True


@pytest.mark.parametrize("sev,up,down", [("INFO", "WARNING", "INFO"), ("WARNING", "ERROR", "INFO"), ("CRITICAL", "CRITICAL", "ERROR")])
def test_steps(spark, sev, up, down):
    assert one(spark, severity.step_severity(F.lit(sev), 1)) == up
    assert one(spark, severity.step_severity(F.lit(sev), -1)) == down


def test_level_names(spark):
    assert one(spark, severity.level_name(F.lit(5))) == "VERBOSE"
    assert one(spark, severity.level_name(F.lit(9))) == "LEVEL_9"


@pytest.mark.parametrize("s,want", [(0.75, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM"), (0.29, "LOW")])
def test_anomaly_tier(spark, s, want):
    assert one(spark, severity.anomaly_tier(F.lit(s))) == want


def test_json_helpers(spark):
    assert one(spark, text.merge_json(F.lit('{"a":1,"b":[2]}'), F.lit('{"b":"x"}'))) == '{"a":1,"b":"x"}'
    assert one(spark, text.merge_json(F.lit("nope"), F.lit('{"b":null}'))) == '{"b":null}'
    assert one(spark, F.size(text.json_text_map(F.lit("[1]")))) == 0
    assert one(spark, text.diagnostic_text(F.lit('{"message":"","error":"e","detail":"d"}'))) == "e"
    assert one(spark, text.diagnostic_text(F.lit("{bad"))) is None


@pytest.mark.parametrize("raw,want", [("ALERT-12", 12), ("12", 12), ("ALERT-x", None), ("ALERT-", None), ("ALERT-ALERT-1", None), ("", None)])
def test_alert_number(spark, raw, want):
    assert one(spark, text.alert_number(F.lit(raw))) == want


def test_wildcards_in_search(spark):
    assert one(spark, text.search_any("a_c", F.lit("xABCx")))
    assert not one(spark, text.contains_any("a_c", F.lit("xABCx")))


NS = "xmlns='http://schemas.microsoft.com/win/2004/08/events/event'"


@pytest.mark.parametrize(
    "raw,want",
    [
        (f"<Event {NS}><RenderingInfo><Message>  hello </Message></RenderingInfo></Event>", "hello"),
        (f"<Event {NS}><EventData><Data>a</Data><Data Name='n'>b</Data><Data>c</Data><Data>d</Data></EventData></Event>", "a | b | c"),
        ("<Event><EventData><Data>solo</Data></EventData></Event>", "solo"),
        ("", None),
        (None, None),
        ("<not < valid > xml", None),
        ("<Event></Event>", None),
    ],
)
def test_describe_xml(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert xml.with_description(df, "raw", "d").first()["d"] == want


def test_xml_metadata_quirks(spark):
    good = "<Event><System><Provider Name='P'/><EventID Qualifiers='1'>5</EventID><Level>2</Level><EventRecordID>9</EventRecordID><Execution ProcessID='4'/></System><Message>a\nb</Message></Event>"
    rows = xml.extract_metadata(spark.createDataFrame([(good,), ("<Event/>",)], "raw string"), "raw").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.event_record_id, r.provider_name, r.event_id, r.level, r.process_id, r.keywords, r.event_message) == (9, "P", 0, 2, 0, "0x0", "")


@pytest.mark.parametrize(
    "provider,code,level,want",
    [
        ("Microsoft-Windows-Kernel-Power", 41, 1, "SYSTEM_FAULT"),
        ("Microsoft-Windows-Kernel-Power", 1, 3, "UNKNOWN"),
        ("service control manager", 7034, 2, "SERVICE_ERROR"),
        ("Service Control Manager", 1, 2, "SERVICE_ERROR"),
        ("Microsoft-Windows-DistributedCOM", 5, 3, "SECURITY_EVENT"),
        ("SQLServer", None, 3, "SERVICE_ERROR"),
        (None, None, 1, "SYSTEM_FAULT"),
        ("Other", 1, 4, "UNKNOWN"),
        ("disk", 153, 3, "RESOURCE_WARNING"),
    ],
)
def test_classify(spark, provider, code, level, want):
    c = classify.classify_fault(F.lit(provider).cast("string"), F.lit(code).cast("int"), F.lit(level))
    assert one(spark, c) == want


@pytest.mark.parametrize("message,subtype,conf", [("App crash and hang", "CRASH", 0.5), ("Timeout!", "TIMEOUT", 0.5), ("quiet", "UNKNOWN", 0.2), ("service failure", "FAILURE", 0.5)])
def test_keywords(spark, message, subtype, conf):
    df = classify.classify_unknown(spark.createDataFrame([("P", message, 3)], "p string, m string, c int"), F.col("p"), F.col("m"), F.col("c"))
    r = df.first()
    assert (r.kw_subtype, r.kw_confidence) == (subtype, conf)


@pytest.mark.parametrize("name,kept", [("Microsoft-Windows-DNS-Client", False), ("NetworkProfile", False), ("Kernel-Power", True), (None, True)])
def test_provider_exclusion(spark, name, kept):
    assert one(spark, shaping.kept_provider(F.lit(name).cast("string"))) is kept


def test_diagnostic_context_thresholds_are_strict(spark):
    c = classify.diagnostic_context(F.lit(90.0), F.lit(95.5), F.lit(9.0))
    got = one(spark, F.to_json(c))
    assert got == '{"resource_state":{"cpu_percent":90.0,"memory_percent":95.5,"disk_free_percent":9.0},"resource_alerts":["HIGH MEMORY: 95.5%","LOW DISK: 9.0% free"]}'


@pytest.mark.parametrize(
    "condition,parsed",
    [
        ("cpu > 90", ("cpu_usage_percent", ">", "90")),
        ("  mem>=1.5 ", ("memory_usage_percent", ">=", "1.5")),
        ("fault_type = 'X Y'", ("fault_type", "=", "X Y")),
        ("cpu == 90", ("cpu_usage_percent", "=", "= 90")),
        ("message contains \"disk\"", ("normalized_message", "contains", "disk")),
        ("a.b != 3", ("a.b", "!=", "3")),
        ("cpu above 9", None),
        ("", None),
        ("message CONTAINS x", None),
    ],
)
def test_parse_rule(spark, condition, parsed):
    rows = rules.parse_rules(spark.createDataFrame([(condition,)], "condition string")).collect()
    assert ((rows[0].field, rows[0].op, rows[0].expected) if rows else None) == parsed


def test_parse_rule_fixed_double_equals(spark):
    r = rules.parse_rules(spark.createDataFrame([("cpu == 90",)], "condition string"), True).first()
    assert (r.op, r.expected) == ("==", "90")


@pytest.mark.parametrize(
    "actual,op,expected,want",
    [
        ("91", ">", "90", True),
        ("9", ">", "10", False),
        ("b", ">", "a", True),
        ("ERROR", "=", "error", True),
        ("10.0", "=", "10", True),
        ("5d", "=", "5", False),
        ("nan", "=", "nan", True),
        (None, "!=", "x", False),
        ("Disk full", "contains", "DISK", True),
        ("1", "!=", "2", True),
    ],
)
def test_condition(spark, actual, op, expected, want):
    assert one(spark, rules.condition_holds(F.lit(actual).cast("string"), F.lit(op), F.lit(expected))) is want


def test_host_status_order(spark):
    now = datetime(2024, 1, 1)
    fresh, stale = clock.at(now - timedelta(seconds=120)), clock.at(now - timedelta(seconds=121))
    assert one(spark, shaping.host_status(F.lit(3), F.lit(0.0), F.lit(0.0), fresh, now)) == "degraded"
    assert one(spark, shaping.host_status(F.lit(3), F.lit(0.0), F.lit(0.0), stale, now)) == "offline"
    assert one(spark, shaping.host_status(F.lit(0), F.lit(90.0), F.lit(95.0), F.lit(None).cast("timestamp"), now)) == "online"


def test_empty_freshness(spark):
    r = shaping.freshness(spark.createDataFrame([], "ingested_at timestamp"), datetime(2024, 1, 1)).first()
    assert (r.status, r.delay_seconds) == ("OK", 0)
