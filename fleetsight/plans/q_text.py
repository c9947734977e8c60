"""Text, scalar, shaping, classification and report queries (F-*, P-*, J-8, J-9, J-17, A-13 .. A-17, A-DET, A-RPT, S-17, S-18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.functions import coerce, severity, text, xml
from fleetsight.functions.clock import at
from fleetsight.operators import classify, report, shaping
from fleetsight.operators.incidents import signal_intensity
from fleetsight.plans.derived import event_xml
from fleetsight.plans.oracle_views import mean
from fleetsight.plans.registry import query
from fleetsight.sources.adapter import DAY

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean_sql(c: str) -> str:
    return f"left(trim(regexp_replace(regexp_replace(coalesce({c},''), '<[^>]+>', ' ', 'g'), '{SPACE}', ' ', 'g')), 500)"


@query("f01_clean_pages", f"SELECT page_id, {clean_sql('html')} AS message FROM pages")
def _(t):
    return t.table("pages").select("page_id", text.clean_message(F.col("html")).alias("message"))


@query("f01_clean_documents", f"SELECT doc_id, {clean_sql('text')} AS message FROM documents")
def _(t):
    return t.table("documents").select("doc_id", text.clean_message(F.col("text")).alias("message"))


@query("f02_normalized_message", f"SELECT page_id, lower({clean_sql('html')}) AS message FROM pages")
def _(t):
    return t.table("pages").select("page_id", text.normalized_message(F.col("html")).alias("message"))


@query("f03_truncate_bytes", """
SELECT page_id, CASE WHEN strlen(html) <= 4096 THEN html ELSE left(html, (SELECT max(k) FROM range(1024, 4097) r(k) WHERE strlen(left(html, CAST(k AS INT))) <= 4096)) END AS cut FROM pages""")
def _(t):
    return t.table("pages").select("page_id", text.truncate_utf8(F.col("html"), 4096).alias("cut"))


@query("f04_event_hash", "SELECT doc_id, sha256(text || lang || CAST(doc_id AS VARCHAR)) AS event_hash FROM documents")
def _(t):
    return t.table("documents").select("doc_id", text.event_hash(F.col("text"), F.col("lang"), F.col("doc_id")).alias("event_hash"))


@query("f05_padded_alert_keys", """
SELECT id, sha256('native|' || system_id || '|' || severity || '|' || fault_type || '|' || coalesce(fault_subtype,'UNKNOWN') || '|' || provider_name) AS native_key FROM tel""")
def _(t):
    c = F.col
    padded = [F.concat(F.lit("\t "), c("system_id"), F.lit("\n")), F.concat(c("severity"), F.lit("\u00a0")), F.concat(F.lit("\u2003\x1c"), c("fault_type"))]
    return t.tel.select("id", text.native_alert_key(*padded, c("fault_subtype"), F.concat(F.lit("\r\n"), c("provider_name"))).alias("native_key"))


@query("f05_alert_keys", """
SELECT id, sha256('native|' || system_id || '|' || severity || '|' || fault_type || '|' || coalesce(fault_subtype,'UNKNOWN') || '|' || provider_name) AS native_key,
 sha256('rule|' || CAST(event_code AS VARCHAR) || '|' || system_id || '|' || severity || '|' || fault_type) AS rule_key FROM tel""")
def _(t):
    c = F.col
    return t.tel.select(
        "id",
        text.native_alert_key(c("system_id"), c("severity"), c("fault_type"), c("fault_subtype"), c("provider_name")).alias("native_key"),
        text.rule_alert_key(c("event_code"), c("system_id"), c("severity"), c("fault_type")).alias("rule_key"),
    )


@query("f06_resource_hash", """
SELECT id, sha256('resource::' || system_id || '::' || CAST(CAST(round_even(cpu_usage_percent, 1) AS DECIMAL(12,1)) AS VARCHAR) || '::'
 || CAST(CAST(memory_usage_percent AS DECIMAL(12,1)) AS VARCHAR) || '::' || CAST(CAST(disk_free_percent AS DECIMAL(12,1)) AS VARCHAR)) AS event_hash FROM tel""")
def _(t):
    hashed = text.resource_hash(F.col("system_id"), F.col("cpu_usage_percent"), F.col("memory_usage_percent"), F.col("disk_free_percent"))
    return t.tel.select("id", hashed.alias("event_hash"))


@query("f07_xml_metadata", """
SELECT id AS event_record_id, provider_name, event_code AS event_id, level, 3 AS task, 0 AS opcode, '0x80ff' AS keywords, 0 AS process_id, 0 AS thread_id,
 strftime(ingested_at, '%Y-%m-%dT%H:%M:%S') AS event_time, CASE WHEN severity = 'CRITICAL' THEN ' driver ' || event_message || ' ' ELSE '' END AS event_message
FROM tel WHERE provider_name <> 'App-Host'""")
def _(t):
    rows = t.tel.select(event_xml().alias("raw_xml"))
    return xml.extract_metadata(rows, "raw_xml", at(t.as_of)).drop("raw_xml")


DESCRIBED = """CASE WHEN fault_subtype IS NULL THEN NULL WHEN severity = 'CRITICAL' THEN 'driver ' || event_message
 ELSE fault_type || ' | ' || system_id || ' | ' || CAST(id AS VARCHAR) END"""


@query("f08_xml_description", f"SELECT id, {DESCRIBED} AS description FROM tel")
def _(t):
    return xml.with_description(t.tel.select("id", event_xml().alias("raw_xml")), "raw_xml", "description").drop("raw_xml")


def keyword_sql(expr: str, position: int) -> str:
    cases = " ".join(f"WHEN contains(lower({expr}), '{k[0]}') THEN '{k[position]}'" for k in classify.KEYWORDS)
    return f"CASE {cases} END"


@query("f09_keyword_class_documents", f"""
SELECT doc_id, coalesce({keyword_sql("source || ' ' || text", 1)}, 'UNKNOWN') AS subtype, coalesce({keyword_sql("source || ' ' || text", 2)}, 'Unknown Event ' || CAST(doc_id AS VARCHAR)) AS title,
 CASE WHEN {keyword_sql("source || ' ' || text", 1)} IS NULL THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM documents""")
def _(t):
    rows = classify.classify_unknown(t.table("documents"), F.col("source"), F.col("text"), F.col("doc_id"))
    return rows.select("doc_id", F.col("kw_subtype").alias("subtype"), F.col("kw_title").alias("title"), F.col("kw_confidence").alias("confidence"))


@query("f09_keyword_class_pages", f"""
SELECT subtype, count(*) AS pages FROM (SELECT coalesce({keyword_sql("url || ' ' || html", 1)}, 'UNKNOWN') AS subtype FROM pages) p GROUP BY 1""")
def _(t):
    rows = classify.classify_unknown(t.table("pages"), F.col("url"), F.col("html"), F.col("page_id"))
    return rows.groupBy(F.col("kw_subtype").alias("subtype")).agg(F.count(F.lit(1)).alias("pages"))


@query("f10_diagnostic_context", """
SELECT id, '{"resource_state":{"cpu_percent":' || c || ',"memory_percent":' || m || ',"disk_free_percent":' || d || '},"resource_alerts":['
 || concat_ws(',', CASE WHEN cpu_usage_percent > 90 THEN '"HIGH CPU: ' || c || '%"' END, CASE WHEN memory_usage_percent > 90 THEN '"HIGH MEMORY: ' || m || '%"' END,
  CASE WHEN disk_free_percent < 10 THEN '"LOW DISK: ' || d || '% free"' END) || ']}' AS context
FROM (SELECT *, CAST(CAST(cpu_usage_percent AS DOUBLE) AS VARCHAR) AS c, CAST(CAST(memory_usage_percent AS DOUBLE) AS VARCHAR) AS m, CAST(CAST(disk_free_percent AS DOUBLE) AS VARCHAR) AS d FROM tel) x""")
def _(t):
    c = [F.col(n).cast("double") for n in ("cpu_usage_percent", "memory_usage_percent", "disk_free_percent")]
    return t.tel.select("id", F.to_json(classify.diagnostic_context(*c)).alias("context"))


@query("f11_json_map", """
SELECT id, CASE WHEN severity = 'INFO' THEN NULL ELSE json_extract_string(diagnostic_context, '$.k') END AS k, CASE WHEN severity = 'INFO' THEN 0 ELSE 1 END AS size FROM tel""")
def _(t):
    m = text.json_text_map(F.when(F.col("severity") == "INFO", F.col("event_message")).otherwise(F.col("diagnostic_context")))
    return t.tel.select("id", F.try_element_at(m, F.lit("k")).alias("k"), F.size(m).alias("size"))


@query("f12_json_merge", """
SELECT id, CASE WHEN severity = 'CRITICAL' THEN '{"k":true}' ELSE '{"k":' || json_extract_string(diagnostic_context, '$.k') || ',"sev":"' || severity || '"}' END AS merged FROM tel""")
def _(t):
    patch = F.when(F.col("severity") == "CRITICAL", F.lit('{"k": true}')).otherwise(F.to_json(F.struct(F.col("severity").alias("sev"))))
    return t.tel.select("id", text.merge_json(F.col("diagnostic_context"), patch).alias("merged"))


@query("f13_severity_steps", """
SELECT id, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END AS rank, CASE level WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'WARNING' ELSE 'INFO' END AS level_name,
 CASE severity WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'ERROR' THEN 'CRITICAL' WHEN 'WARNING' THEN 'ERROR' ELSE 'WARNING' END AS up,
 CASE severity WHEN 'CRITICAL' THEN 'ERROR' WHEN 'ERROR' THEN 'WARNING' ELSE 'INFO' END AS down FROM tel""")
def _(t):
    s = F.col("severity")
    return t.tel.select(
        "id", severity.severity_rank(s).alias("rank"), severity.level_name(F.col("level")).alias("level_name"), severity.step_severity(s, 1).alias("up"), severity.step_severity(s, -1).alias("down")
    )


@query("f16_intensity", """
SELECT system_id, n, round(CASE WHEN n <= 1 THEN 0 ELSE least(log2(n)/log2(100), 1.0) END, 9) AS intensity, CAST(greatest(0, least(100, 120 - n)) AS BIGINT) AS clamped FROM (SELECT system_id, count(*) AS n FROM tel GROUP BY 1) x""")
def _(t):
    rows = t.tel.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("system_id", "n", F.round(signal_intensity(F.col("n")), 9).alias("intensity"), coerce.clamp(F.lit(120) - F.col("n"), 0, 100).alias("clamped"))


@query("f17_alert_numbers", """
SELECT id, CASE severity WHEN 'CRITICAL' THEN id WHEN 'ERROR' THEN NULL WHEN 'WARNING' THEN NULL ELSE id END AS number FROM tel""")
def _(t):
    n, s = F.col("id").cast("string"), F.col("severity")
    shaped = F.when(s == "CRITICAL", F.concat(F.lit("ALERT-"), n)).when(s == "ERROR", F.concat(F.lit("ALERT-x"), n)).when(s == "WARNING", F.concat(F.lit("INC-"), n)).otherwise(n)
    return t.tel.select("id", text.alert_number(shaped).alias("number"))


SEARCH = "fault_type ILIKE '%{q}%' OR system_id ILIKE '%{q}%' OR coalesce(hostname,'') ILIKE '%{q}%' OR provider_name ILIKE '%{q}%' OR coalesce(event_message,'') ILIKE '%{q}%' OR coalesce(diagnostic_context,'') ILIKE '%{q}%'"
EVENT_COLS = "id, system_id, hostname, severity, fault_type, ingested_at"


@query("p01_event_search", f"SELECT {EVENT_COLS} FROM tel WHERE severity = 'WARNING' AND ({SEARCH.format(q='PURCHASE on_user 1')}) ORDER BY ingested_at DESC, id DESC LIMIT 4000")
def _(t):
    return shaping.search_events(t.tel, 4000, severity="WARNING", search="PURCHASE on_user 1").select(*[c.strip() for c in EVENT_COLS.split(",")])


@query("p01_event_filter", f"SELECT {EVENT_COLS} FROM tel WHERE fault_type = 'SERVICE_ERROR' AND ({SEARCH.format(q='host-1')})")
def _(t):
    return shaping.filter_events(t.tel, fault_type="SERVICE_ERROR", search="host-1").select(*[c.strip() for c in EVENT_COLS.split(",")])


@query("p01_document_search", "SELECT doc_id, source FROM documents WHERE text ILIKE '%the%in_%' OR source ILIKE '%the%in_%'")
def _(t):
    return t.table("documents").filter(text.search_any("the%in_", F.col("text"), F.col("source"))).select("doc_id", "source")


@query("l01_newest_events", f"SELECT {EVENT_COLS} FROM tel ORDER BY ingested_at DESC, id DESC LIMIT 100")
def _(t):
    return shaping.search_events(t.tel).select(*[c.strip() for c in EVENT_COLS.split(",")])


@query("l03_live_events", f"SELECT {EVENT_COLS} FROM tel ORDER BY ingested_at DESC, id DESC LIMIT 12")
def _(t):
    return shaping.newest(t.tel, "ingested_at", 12, "id").select(*[c.strip() for c in EVENT_COLS.split(",")])


@query("p02_shaped_events", """
SELECT id, CASE WHEN hostname = '' THEN system_id ELSE hostname END AS hostname, id AS event_record_id, ingested_at AS event_time, CAST(coalesce(confidence_score, 0.20) AS DOUBLE) AS confidence_score,
 coalesce(fault_subtype, '') AS fault_subtype, event_message AS fault_description, '' AS parsed_message FROM tel""")
def _(t):
    return shaping.shape_event(t.tel).select("id", "hostname", "event_record_id", "event_time", "confidence_score", "fault_subtype", "fault_description", "parsed_message")


@query("p03_diagnostic_text", """
SELECT id, CASE severity WHEN 'CRITICAL' THEN event_message WHEN 'ERROR' THEN 'd-' || CAST(id AS VARCHAR) WHEN 'WARNING' THEN NULL ELSE NULL END AS described FROM tel""")
def _(t):
    s, e = F.col("severity"), F.col("event_message")
    diag = (
        F.when(s == "CRITICAL", F.to_json(F.struct(e.alias("message"), F.lit("later").alias("detail"))))
        .when(s == "ERROR", F.to_json(F.struct(F.lit("").alias("message"), F.concat(F.lit("d-"), F.col("id").cast("string")).alias("detail"))))
        .when(s == "WARNING", F.concat(F.lit("{broken "), e))
        .otherwise(F.col("diagnostic_context"))
    )
    return t.tel.select("id", text.diagnostic_text(diag).alias("described"))


@query("p10_kept_providers", "SELECT id, provider_name FROM (SELECT id, CASE WHEN severity = 'ERROR' THEN 'x-WLAN-' || provider_name ELSE provider_name END AS provider_name FROM tel) x WHERE NOT regexp_matches(lower(provider_name), 'tcpip|dns|dhcp|wlan|smb|network|firewall|winhttp|wininet')")
def _(t):
    named = F.when(F.col("severity") == "ERROR", F.concat(F.lit("x-WLAN-"), F.col("provider_name"))).otherwise(F.col("provider_name"))
    rows = t.tel.select("id", named.alias("provider_name"))
    return rows.filter(shaping.kept_provider(F.col("provider_name")))


@query("p11_collected_levels", "SELECT id, level FROM tel WHERE level IN (1, 2, 3) AND fault_type <> 'SECURITY_EVENT'")
def _(t):
    rows = t.tel.withColumn("level", F.when(F.col("fault_type") != "SECURITY_EVENT", F.col("level")))
    return rows.filter(shaping.collected_level(F.col("level"))).select("id", "level")


@query("p12_dashboard_events", """
SELECT id, system_id FROM tel WHERE ingested_at >= (SELECT as_of FROM clk) - INTERVAL 20 DAYS AND (system_id IN ('SYS-0003','host-7') OR hostname IN ('SYS-0003','host-7','host-12') OR hostname = 'host-12')
 AND severity IN ('CRITICAL','WARNING') AND fault_type IN ('SERVICE_ERROR','SECURITY_EVENT') AND (contains(lower(event_message), 'on') OR contains(CAST(event_code AS VARCHAR), 'on'))""")
def _(t):
    rows = shaping.dashboard_events(t.tel, t.as_of, 20 * DAY, ["SYS-0003", "host-7", "host-12"], ["CRITICAL", "WARNING"], ["SERVICE_ERROR", "SECURITY_EVENT"], "ON")
    return rows.select("id", "system_id")


@query("p19_coercions", """
SELECT id, CASE severity WHEN 'CRITICAL' THEN id WHEN 'ERROR' THEN -1 WHEN 'WARNING' THEN -1 ELSE CAST(trunc(cpu_usage_percent) AS BIGINT) END AS as_int,
 CASE severity WHEN 'CRITICAL' THEN CAST(id AS DOUBLE) WHEN 'ERROR' THEN CAST(cpu_usage_percent AS DOUBLE) WHEN 'WARNING' THEN 0.5 ELSE CAST(cpu_usage_percent AS DOUBLE) END AS as_float,
 CASE severity WHEN 'CRITICAL' THEN CAST(id AS VARCHAR) WHEN 'ERROR' THEN CAST(cpu_usage_percent AS VARCHAR) WHEN 'WARNING' THEN event_message ELSE 'none' END AS as_text FROM tel""")
def _(t):
    s, cpu = F.col("severity"), F.col("cpu_usage_percent")
    raw = F.when(s == "CRITICAL", F.concat(F.lit(" "), F.col("id").cast("string"))).when(s == "ERROR", cpu.cast("string")).when(s == "WARNING", F.col("event_message"))
    info = s == "INFO"
    return t.tel.select(
        "id",
        F.when(info, coerce.int_or(cpu, -1)).otherwise(coerce.int_or(raw, -1, is_text=True)).alias("as_int"),
        F.when(info, coerce.float_or(cpu, 0.5)).otherwise(coerce.float_or(raw, 0.5, is_text=True)).alias("as_float"),
        coerce.text_or(raw, "none").alias("as_text"),
    )


@query("p22_sanitized_events", """
SELECT id, CASE WHEN hostname = '' THEN system_id ELSE hostname END AS hostname, ingested_at AS event_time, event_message AS fault_description FROM tel""")
def _(t):
    return shaping.sanitize_event(t.tel, t.as_of).select("id", "hostname", "event_time", "fault_description")


def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


RULES_SQL = _values([(i, *r) for i, r in enumerate(classify.CLASSIFICATION)])


@query("j09_classified_faults", f"""
SELECT k.provider_name, k.event_code, k.level, k.n, coalesce((SELECT arg_min(f, o) FROM (VALUES {RULES_SQL}) r(o, p, c, f) WHERE contains(lower(k.provider_name), lower(p)) AND (c IS NULL OR c = k.event_code)),
  CASE k.level WHEN 1 THEN 'SYSTEM_FAULT' WHEN 2 THEN 'SERVICE_ERROR' ELSE 'UNKNOWN' END) AS fault
FROM (SELECT provider_name || CASE WHEN fault_subtype IS NULL THEN ' TPM' ELSE '' END AS provider_name, event_code, level, count(*) AS n FROM tel GROUP BY 1, 2, 3) k""")
def _(t):
    named = t.tel.withColumn("provider_name", F.concat("provider_name", F.when(F.col("fault_subtype").isNull(), " TPM").otherwise("")))
    return classify.classified(named).groupBy("provider_name", "event_code", "level", F.col("class_fault").alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query("j08_knowledge_lookup", """
SELECT id, CASE WHEN fault_subtype IS NULL THEN 'Windows Service Extension Event' WHEN provider_name = 'Service Control Manager' THEN 'Service Crash and Restart'
 WHEN provider_name = 'Microsoft-Windows-Kernel-Processor-Power' THEN 'CPU Thermal Throttling' WHEN provider_name = 'Microsoft-Windows-DistributedCOM' THEN 'DCOM Permission Violation'
 WHEN provider_name = 'Netwtw14' THEN 'Intel WiFi Driver Event' END AS title, CASE WHEN fault_subtype IS NULL THEN 2 WHEN provider_name = 'App-Host' THEN NULL WHEN provider_name = 'Service Control Manager' THEN 3
 WHEN provider_name = 'Microsoft-Windows-Kernel-Processor-Power' THEN 4 WHEN provider_name = 'Microsoft-Windows-DistributedCOM' THEN 2 ELSE 3 END AS causes FROM tel""")
def _(t):
    named = t.tel.withColumn("provider_name", F.when(F.col("fault_subtype").isNull(), F.concat(F.lit("My-WinSrvExt-"), F.col("provider_name"))).otherwise(F.col("provider_name")))
    rows = classify.with_knowledge(named)
    return rows.select("id", F.col("kb_title").alias("title"), F.when(F.col("kb_causes").isNotNull(), F.size("kb_causes")).alias("causes"))


@query("a_det_detected_errors", f"""
SELECT id AS event_record_id, provider_name, event_code, level, severity AS level_name, ingested_at AS event_time, fault_type, true AS known, 'KNOWN' AS fault_subtype, 0.9::DOUBLE AS confidence_score,
 CAST(cpu_usage_percent AS DOUBLE) AS cpu_at_time, coalesce({DESCRIBED}, '') AS description FROM tel WHERE level < 4""")
def _(t):
    rows = classify.detect_errors(t.tel.withColumn("raw_xml", event_xml()))
    return rows.select("event_record_id", "provider_name", "event_code", "level", "level_name", "event_time", "fault_type", "known", "fault_subtype", "confidence_score", "cpu_at_time", "description")


@query("a_det_unknown_providers", f"""
SELECT id AS event_record_id, coalesce({keyword_sql("'Other ' || coalesce(" + DESCRIBED + ", '')", 1)}, 'UNKNOWN') AS fault_subtype, coalesce({keyword_sql("'Other ' || coalesce(" + DESCRIBED + ", '')", 2)}, 'Unknown Event ' || CAST(event_code AS VARCHAR)) AS title,
 CASE WHEN {keyword_sql("'Other ' || coalesce(" + DESCRIBED + ", '')", 1)} IS NULL THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS confidence_score, 'Check Event Viewer for details' AS solutions FROM tel WHERE level < 4""")
def _(t):
    rows = classify.detect_errors(t.tel.withColumn("raw_xml", event_xml()).withColumn("provider_name", F.lit("Other")))
    return rows.select("event_record_id", "fault_subtype", "title", "confidence_score", "solutions")


@query("a13_report_counters", """
WITH c AS (
 SELECT 'channel' AS dimension, log_channel AS value, count(*) AS count FROM tel GROUP BY 2 UNION ALL SELECT 'level', CAST(level AS VARCHAR), count(*) FROM tel GROUP BY 2
 UNION ALL SELECT 'fault', fault_type, count(*) FROM tel GROUP BY 2 UNION ALL SELECT 'provider', provider_name, count(*) FROM tel GROUP BY 2 UNION ALL SELECT 'event_code', CAST(event_code AS VARCHAR), count(*) FROM tel GROUP BY 2)
SELECT dimension, value, count, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value) AS position, CAST(round(count*100.0/(SELECT count(*) FROM tel), 1) AS DOUBLE) AS percent,
 CASE WHEN dimension = 'event_code' THEN (SELECT arg_min(provider_name, ingested_at) FROM tel WHERE CAST(event_code AS VARCHAR) = value) END AS example FROM c""")
def _(t):
    return report.report_counters(t.tel)


@query("a14_resource_usage", "SELECT m AS metric, lo AS min, hi AS max, av AS avg FROM (" + " UNION ALL ".join(
    f"SELECT '{label}' AS m, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, {mean(c, 1)} AS av FROM tel"
    for label, c in (("CPU %", "cpu_usage_percent"), ("Memory %", "memory_usage_percent"), ("Disk Free %", "disk_free_percent"))) + ") u")
def _(t):
    return report.resource_usage(t.tel)


@query("a15_fault_patterns", """
SELECT provider_name, event_code, CASE provider_name WHEN 'Service Control Manager' THEN 'Service Crash and Restart' WHEN 'Microsoft-Windows-Kernel-Processor-Power' THEN 'CPU Thermal Throttling' ELSE 'DCOM Permission Violation' END AS title,
 count(*) AS count, true AS known FROM tel WHERE level < 4 GROUP BY 1, 2 ORDER BY 4 DESC LIMIT 15""")
def _(t):
    return report.fault_patterns(classify.detect_errors(t.tel, None))


@query("a15_error_levels", "SELECT count(*) AS issues, count(*) FILTER (WHERE level=1) AS critical, count(*) FILTER (WHERE level=2) AS error, count(*) FILTER (WHERE level=3) AS warning FROM tel WHERE level < 4")
def _(t):
    return report.error_levels(classify.detect_errors(t.tel, None))


@query("a15_root_causes", """
SELECT provider_name, event_code, count(*) AS count, min(level) AS worst_level, CASE provider_name WHEN 'Service Control Manager' THEN 'A service terminated unexpectedly and was scheduled for restart.'
 WHEN 'Microsoft-Windows-Kernel-Processor-Power' THEN 'Processor speed was limited by system firmware.' ELSE 'Application-specific permission settings do not grant Local Activation permission.' END AS diagnosis
FROM tel WHERE level < 4 GROUP BY 1, 2""")
def _(t):
    return report.root_causes(classify.detect_errors(t.tel, None)).select("provider_name", "event_code", "count", "worst_level", "diagnosis")


@query("a16_pattern_insights", """
SELECT place, n AS count, replace(txt, '{}', CAST(n AS VARCHAR)) AS insight FROM (
 SELECT 1 AS place, count(*) FILTER (WHERE level = 3) AS n, 100 AS lim, '{} warning events collected — review patterns for recurring issues' AS txt FROM tel
 UNION ALL SELECT 2, count(*) FILTER (WHERE contains(provider_name,'DistributedCOM')), 50, 'High DCOM event count ({}) — typically benign but reducible via permissions config' FROM tel
 UNION ALL SELECT 3, count(*) FILTER (WHERE contains(provider_name,'Kernel-PnP')), 20, 'Multiple Plug-and-Play events ({}) — consider updating device drivers' FROM tel
 UNION ALL SELECT 4, count(*) FILTER (WHERE contains(provider_name,'Processor-Power') AND event_code = 37), 10, 'CPU throttling detected ({} events) — check cooling and power settings' FROM tel
 UNION ALL SELECT 5, count(*) FILTER (WHERE contains(provider_name,'Netwtw')), 15, 'WiFi driver instability ({} events) — update Intel WiFi drivers' FROM tel) u WHERE n > lim""")
def _(t):
    return report.pattern_insights(t.tel)


@query("a17_resource_alerts", """
SELECT type, severity, n AS count, head || CAST(n AS VARCHAR) || ' event capture(s)' AS message, action FROM (
 SELECT 'HIGH_CPU' AS type, 'WARNING' AS severity, count(*) FILTER (WHERE cpu_usage_percent > 90) AS n, 'CPU exceeded 90% during ' AS head, 'Review running processes; check for CPU-intensive background tasks' AS action FROM tel
 UNION ALL SELECT 'HIGH_MEMORY', 'WARNING', count(*) FILTER (WHERE memory_usage_percent > 90), 'Memory exceeded 90% during ', 'Identify memory-intensive processes; consider adding RAM' FROM tel
 UNION ALL SELECT 'LOW_DISK', 'CRITICAL', count(*) FILTER (WHERE disk_free_percent < 10), 'Disk free below 10% during ', 'Free disk space immediately; run Disk Cleanup' FROM tel) u WHERE n > 0""")
def _(t):
    return report.resource_alerts(t.tel)


@query("a_rpt_analysis_report", """
SELECT 'alerts' AS section, count(*) AS rows FROM (VALUES (1),(2),(3)) v UNION ALL SELECT 'counters', (SELECT count(DISTINCT log_channel) + count(DISTINCT level) + count(DISTINCT fault_type) + count(DISTINCT provider_name) + count(DISTINCT event_code) FROM tel)
UNION ALL SELECT 'insights', (SELECT CASE WHEN count(*) FILTER (WHERE level=3) > 100 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE event_code=10016) > 50 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE event_code=37) > 10 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE event_code=5002) > 15 THEN 1 ELSE 0 END FROM tel)
UNION ALL SELECT 'levels', 1 UNION ALL SELECT 'patterns', (SELECT count(DISTINCT event_code) FROM tel WHERE level < 4) UNION ALL SELECT 'resources', 3 UNION ALL SELECT 'root_causes', (SELECT count(DISTINCT event_code) FROM tel WHERE level < 4)""")
def _(t):
    sections = report.analysis_report(t.tel)
    rows = None
    for name, df in sections.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("section"), "rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("j17_annotated_events", """
SELECT id, CASE WHEN level < 4 THEN CASE provider_name WHEN 'Service Control Manager' THEN 'Service Crash and Restart' WHEN 'Microsoft-Windows-Kernel-Processor-Power' THEN 'CPU Thermal Throttling' ELSE 'DCOM Permission Violation' END END AS title FROM tel""")
def _(t):
    return report.annotate_events(t.tel, classify.detect_errors(t.tel, None)).select("id", "title")


@query("s17_csv_lines", """
SELECT id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z,' || severity || ',' || CASE WHEN hostname = '' THEN system_id ELSE hostname END || ',' || provider_name || ',' || fault_type || ',"' || event_message || '"' AS line FROM tel""")
def _(t):
    return report.csv_export(shaping.shape_event(t.tel))


@query("s18_detail_blocks", """
SELECT id, '[' || rpad(severity, 8, ' ') || '] ' || rpad(provider_name, 50, ' ') || ' EventID=' || lpad(CAST(event_code AS VARCHAR), 5, ' ') || '  RecordID=' || CAST(id AS VARCHAR) || chr(10)
 || '       Time    : ' || rtrim(rtrim(strftime(ingested_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') || chr(10) || '       Channel : System' || chr(10) || '       Resources: CPU=' || CAST(CAST(cpu_usage_percent AS DECIMAL(12,1)) AS VARCHAR)
 || '%  MEM=' || CAST(CAST(memory_usage_percent AS DECIMAL(12,1)) AS VARCHAR) || '%  DISK=' || CAST(CAST(disk_free_percent AS DECIMAL(12,1)) AS VARCHAR) || '% free' || chr(10) || '       Desc    : ' || event_message
 || CASE WHEN level < 4 THEN chr(10) || '       ┌─ ' || CASE provider_name WHEN 'Service Control Manager' THEN 'Service Crash and Restart' WHEN 'Microsoft-Windows-Kernel-Processor-Power' THEN 'CPU Thermal Throttling' ELSE 'DCOM Permission Violation' END
  || chr(10) || '       │  ' || CASE provider_name WHEN 'Service Control Manager' THEN 'A service terminated unexpectedly and was scheduled for restart.' WHEN 'Microsoft-Windows-Kernel-Processor-Power' THEN 'Processor speed was limited by system firmware.'
  ELSE 'Application-specific permission settings do not grant Local Activation permission.' END ELSE '' END AS block FROM tel""")
def _(t):
    return report.detail_lines(report.annotate_events(t.tel, classify.detect_errors(t.tel, None)))
