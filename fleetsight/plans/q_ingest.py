"""Ingest queries: envelopes, gates, idempotent append, heartbeats, retention, marks, chunks, merges (S-*, P-20, P-21, U-3, U-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.functions.clock import before
from fleetsight.operators import ingest, scoring
from fleetsight.plans.derived import SECRET, messages
from fleetsight.plans.registry import query
from fleetsight.sources.adapter import DAY

AS_OF = "(SELECT as_of FROM clk)"
WELL_FORMED = "fault_subtype IS NOT NULL"
NAMED = "hostname <> ''"


def _decoded(t):
    return ingest.decode_envelopes(messages(t.tel))


def _accepted(t):
    return ingest.identified(ingest.accepted(_decoded(t), SECRET))


@query("s01_decoded_messages", f"SELECT id AS offset, {WELL_FORMED} AS is_object FROM tel")
def _(t):
    return _decoded(t).select("offset", "is_object")


@query("s02_envelope_flatten", f"""
SELECT id AS event_record_id, system_id, hostname, severity, event_code AS event_id FROM tel WHERE {WELL_FORMED} AND {NAMED} AND severity <> 'WARNING'""")
def _(t):
    rows = ingest.flatten_events(_accepted(t))
    return rows.select("event.event_record_id", "system_id", "hostname", "event.severity", "event.event_id")


@query("s03_secret_gate", f"SELECT id AS offset, {NAMED} AS accepted FROM tel WHERE {WELL_FORMED}")
def _(t):
    d = _decoded(t)
    ok = ingest.accepted(d, SECRET).select("offset", F.lit(True).alias("accepted"))
    return ok.unionByName(ingest.rejected(d, SECRET).select("offset", F.lit(False).alias("accepted")))


@query("s04_identity_gate", f"SELECT id AS offset, system_id FROM tel WHERE {WELL_FORMED} AND ({NAMED} OR fault_type <> 'UNKNOWN')")
def _(t):
    return ingest.identified(_decoded(t).filter("is_object")).select("offset", "system_id")


@query("s07_dead_letters", f"SELECT id AS offset, 'broken ' || event_message AS value FROM tel WHERE NOT ({WELL_FORMED})")
def _(t):
    return ingest.dead_letters(_decoded(t)).select("offset", "value")


@query("p20_prepared_rows", f"""
SELECT id AS event_record_id, system_id, sha256(CAST(id AS VARCHAR)) AS event_hash, '  <b>' || upper(event_message) || '</b>' || chr(9) || ' x ' AS event_message, upper(event_message) || ' x' AS parsed_message,
 event_message || ' x' AS normalized_message, fault_subtype, CAST(CASE WHEN confidence_score IS NULL THEN 0.20 ELSE greatest(0, least(1, confidence_score*4 - 1)) END AS DOUBLE) AS confidence_score,
 CAST(CASE WHEN severity = 'ERROR' THEN 0 ELSE cpu_usage_percent END AS DOUBLE) AS cpu_usage_percent, CAST(memory_usage_percent AS DOUBLE) AS memory_usage_percent, CAST(100 AS DOUBLE) AS disk_free_percent, ingested_at AS received_at
FROM tel WHERE {WELL_FORMED} AND {NAMED} AND severity <> 'WARNING'""")
def _(t):
    rows = ingest.event_rows(_accepted(t).withColumn("ingested_at", F.col("received_at")), "ingested_at")
    return rows.select(
        "event_record_id", "system_id", "event_hash", "event_message", "parsed_message", "normalized_message", "fault_subtype", "confidence_score",
        "cpu_usage_percent", "memory_usage_percent", "disk_free_percent", F.col("ingested_at").alias("received_at"),
    )


@query("s06_heartbeat_upsert", f"""
SELECT system_id, hostname, CAST(CASE WHEN severity IN ('ERROR','WARNING') THEN 0 ELSE cpu_usage_percent END AS DOUBLE) AS cpu_usage_percent, CAST(memory_usage_percent AS DOUBLE) AS memory_usage_percent,
 CAST(100 AS DOUBLE) AS disk_free_percent, 'os-1' AS os_version, 'Unknown' AS agent_version, CAST(0 AS BIGINT) AS uptime_seconds, ingested_at AS last_seen
FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY ingested_at DESC) AS r FROM tel WHERE {WELL_FORMED} AND {NAMED}) x WHERE r = 1""")
def _(t):
    return ingest.latest_heartbeats(ingest.message_heartbeats(_accepted(t), "received_at", "offset"), "offset").drop("ip_address", "offset")


@query("p21_heartbeat_candidates", f"""
SELECT system_id, ingested_at AS last_seen, CAST(CASE WHEN severity IN ('ERROR','WARNING') THEN 0 ELSE cpu_usage_percent END AS DOUBLE) AS cpu_usage_percent, CAST(memory_usage_percent AS DOUBLE) AS memory_usage_percent,
 CAST(100 AS DOUBLE) AS disk_free_percent FROM tel WHERE {WELL_FORMED} AND {NAMED}""")
def _(t):
    return ingest.message_heartbeats(_accepted(t), "received_at").select("system_id", "last_seen", "cpu_usage_percent", "memory_usage_percent", "disk_free_percent")


@query("s05_unseen_documents", """
SELECT doc_id, event_hash FROM (SELECT doc_id, h AS event_hash, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM (SELECT doc_id, CASE WHEN lang <> 'de' THEN sha256(text) END AS h FROM documents) d) x
WHERE event_hash IS NULL OR (r = 1 AND event_hash NOT IN (SELECT sha256(text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1))""")
def _(t):
    docs = t.table("documents")
    rows = docs.select("doc_id", F.when(F.col("lang") != "de", F.sha2("text", 256)).alias("event_hash"))
    stored = docs.join(t.table("labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return ingest.unseen_events(rows, ["doc_id"], target=stored.select(F.sha2("text", 256).alias("event_hash")))


@query("j05_anti_join_hosts", "SELECT id, system_id FROM tel WHERE system_id NOT IN (SELECT system_id FROM hb)")
def _(t):
    return t.tel.join(t.hb.select("system_id"), "system_id", "left_anti").select("id", "system_id")


@query("s08_retained_events", f"SELECT id, ingested_at FROM tel WHERE ingested_at >= {AS_OF} - INTERVAL 20 DAYS")
def _(t):
    return ingest.retained(t.tel, t.as_of, 20).select("id", "ingested_at")


@query("s09_month_partitions", """
SELECT strftime(o_orderdate, '%Y%m') AS event_month, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 1 MONTH AS month_end, count(*) AS events FROM orders GROUP BY 1, 2, 3""")
def _(t):
    orders = t.table("orders").select(F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return ingest.month_partitions(orders, "o_orderdate")


@query("s10_snapshot_rows", """
SELECT system_id, snapshot_time, CAST(cpu_usage_percent AS DOUBLE) AS cpu_usage_percent, CAST(0 AS DOUBLE) AS memory_usage_percent, CAST(100 AS DOUBLE) AS disk_free_percent, total_events, critical_count, error_count, warning_count, info_count,
 CASE WHEN critical_count > 0 THEN dominant_fault_type ELSE 'NONE' END AS dominant_fault_type, CAST(0.2 AS DOUBLE) AS avg_confidence FROM snaps1""")
def _(t):
    from fleetsight.functions.coerce import conform
    from fleetsight.schemas import SNAPSHOT_DEFAULTS, SNAPSHOTS

    rows = t.snaps().drop("memory_usage_percent", "disk_free_percent", "avg_confidence")
    rows = rows.withColumn("dominant_fault_type", F.when(F.col("critical_count") > 0, F.col("dominant_fault_type")))
    return conform(rows, SNAPSHOTS, SNAPSHOT_DEFAULTS)


@query("s11_prediction_rows", """
SELECT system_id, snapshot_time AS prediction_time, CAST(least(1, critical_count/2.0) AS DOUBLE) AS anomaly_score, critical_count > 1 AS is_anomaly, CAST(0 AS DOUBLE) AS failure_probability,
 CASE WHEN error_count > 0 THEN 'E' ELSE 'NONE' END AS predicted_fault, 'v2-isof' AS model_version FROM snaps1""")
def _(t):
    rows = t.snaps().select(
        "system_id",
        "snapshot_time",
        (F.col("critical_count") / 2.0).alias("anomaly_score"),
        (F.col("critical_count") > 1).alias("is_anomaly"),
        (F.col("error_count") * -1.0).alias("failure_probability"),
        F.when(F.col("error_count") > 0, "E").otherwise("").alias("predicted_fault"),
    )
    return scoring.prediction_rows(rows).drop("cluster_id")


MARKS = f"SELECT provider_name AS log_channel, max(id) AS last_record_id FROM tel WHERE ingested_at < {AS_OF} - INTERVAL 10 DAYS AND severity <> 'INFO' GROUP BY 1"


def _channel_records(t):
    return t.tel.select(F.col("provider_name").alias("log_channel"), F.col("id").alias("event_record_id"), "severity", "ingested_at")


def _marks(t):
    old = _channel_records(t).filter((F.col("ingested_at") < before(t.as_of, 10 * DAY)) & (F.col("severity") != "INFO"))
    return ingest.new_marks(old)


@query("s14_incremental_scan", f"""
SELECT provider_name AS log_channel, id AS event_record_id FROM tel LEFT JOIN ({MARKS}) m ON m.log_channel = provider_name WHERE id > coalesce(m.last_record_id, 0)""")
def _(t):
    return ingest.incremental(_channel_records(t), _marks(t)).select("log_channel", "event_record_id")


@query("s14_new_marks", "SELECT provider_name AS log_channel, max(id) AS last_record_id FROM tel GROUP BY 1")
def _(t):
    return ingest.new_marks(_channel_records(t))


@query("s15_tail_bootstrap", "SELECT id, severity FROM tel ORDER BY id DESC LIMIT 50")
def _(t):
    return ingest.tail(t.tel).select("id", "severity")


@query("s15_tail_page", "SELECT id, severity FROM tel WHERE id > 777 ORDER BY id LIMIT 250")
def _(t):
    return ingest.tail(t.tel, 777).select("id", "severity")


CHUNK_SQL = """SELECT system_id AS key, CAST((rn-1)//size AS BIGINT) AS chunk_no, id FROM (
 SELECT system_id, id, row_number() OVER (PARTITION BY system_id ORDER BY ingested_at, id) AS rn, CASE WHEN count(*) OVER (PARTITION BY system_id) <= 20 THEN 20 ELSE least(100, greatest(20, count(*) OVER (PARTITION BY system_id)//2)) END AS size FROM tel) x"""


@query("s16_chunk_rows", CHUNK_SQL)
def _(t):
    return ingest.chunked(t.tel, "system_id", "ingested_at", "id").select(F.col("system_id").alias("key"), "chunk_no", "id")


@query("s16_chunk_messages", f"""
SELECT key, chunk_no, count(*) AS event_count, '{{"system_id":"' || key || '","events":[' || string_agg('{{"id":' || CAST(c.id AS VARCHAR) || ',"severity":"' || t.severity || '"}}', ',' ORDER BY c.id) || '],"agent_key":"s"}}' AS value
FROM ({CHUNK_SQL}) c JOIN tel t ON t.id = c.id GROUP BY 1, 2""")
def _(t):
    chunks = ingest.chunked(t.tel, "system_id", "ingested_at", "id")
    return ingest.chunk_messages(chunks, "system_id", ["severity"], "id", "s")


@query("s16_conversation_chunks", """
SELECT conv_id AS key, CAST((rn-1)//20 AS BIGINT) AS chunk_no, count(*) AS turns FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) x
WHERE n <= 40 GROUP BY 1, 2""")
def _(t):
    # Turns have no clock; one second per turn gives them an order. Conversations above 40 turns would use larger chunks.
    rows = t.table("conversations").withColumn("said_at", F.timestamp_seconds(F.col("turn")))
    chunks = ingest.chunked(rows, "conv_id", "said_at", "turn")
    return chunks.groupBy(F.col("conv_id").alias("key"), "chunk_no").agg(F.count(F.lit(1)).alias("turns"))


@query("u03_merged_events", f"""
SELECT id, event_hash IS NULL AS unhashed, origin FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(event_hash, system_id || '::' || CAST(ingested_at AS VARCHAR) || '::' || CAST(event_code AS VARCHAR)) ORDER BY origin, id) AS r FROM (
 SELECT id, system_id, ingested_at, event_code, CASE WHEN severity <> 'INFO' THEN sha256(system_id || fault_type || CAST(ingested_at::DATE AS VARCHAR)) END AS event_hash, 'current' AS origin FROM tel WHERE ingested_at <= {AS_OF} - INTERVAL 5 DAYS
 UNION ALL SELECT id, system_id, ingested_at, event_code, CASE WHEN severity <> 'INFO' THEN sha256(system_id || fault_type || CAST(ingested_at::DATE AS VARCHAR)) END, 'fresh' FROM tel WHERE ingested_at > {AS_OF} - INTERVAL 15 DAYS) u) x
WHERE r = 1""")
def _(t):
    day = F.date_format("ingested_at", "yyyy-MM-dd")
    hashed = F.when(F.col("severity") != "INFO", F.sha2(F.concat("system_id", "fault_type", day), 256))
    rows = t.tel.withColumn("event_hash", hashed)
    current = rows.filter(F.col("ingested_at") <= before(t.as_of, 5 * DAY)).withColumn("origin", F.lit("current"))
    fresh = rows.filter(F.col("ingested_at") > before(t.as_of, 15 * DAY)).withColumn("origin", F.lit("fresh"))
    merged = ingest.merge_events(current, fresh)
    return merged.select("id", F.col("event_hash").isNull().alias("unhashed"), "origin")


@query("u04_merged_snapshots", """
SELECT system_id, snapshot_time, total_events FROM (SELECT *, row_number() OVER (PARTITION BY system_id, snapshot_time ORDER BY o) AS r FROM (
 SELECT system_id, snapshot_time, total_events, 1 AS o FROM snaps1 UNION ALL SELECT system_id, snapshot_time, total_events * 10, 0 FROM snaps1 WHERE critical_count > 0) u) x WHERE r = 1""")
def _(t):
    snaps = t.snaps()
    fresh = snaps.filter("critical_count > 0").withColumn("total_events", F.col("total_events") * 10)
    return ingest.merge_snapshots(snaps, fresh).select("system_id", "snapshot_time", "total_events")
