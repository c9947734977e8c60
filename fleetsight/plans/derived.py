"""Message and XML inputs that Spark derives from the telemetry rows, for the ingest and text queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECRET = "shared-secret"
NS = "http://schemas.microsoft.com/win/2004/08/events/event"


def event_struct() -> Column:
    return F.struct(
        F.sha2(F.col("id").cast("string"), 256).alias("event_hash"),
        F.col("log_channel"),
        F.col("id").alias("event_record_id"),
        F.col("provider_name"),
        F.col("event_code").alias("event_id"),
        F.col("level"),
        F.col("severity"),
        F.col("fault_type"),
        F.col("fault_subtype"),
        F.col("diagnostic_context"),
        F.concat(F.lit("  <b>"), F.upper("event_message"), F.lit("</b>\t x ")).alias("event_message"),
        F.when(F.col("severity") != "ERROR", F.col("cpu_usage_percent").cast("double")).alias("cpu_usage_percent"),
        (F.col("confidence_score").cast("double") * 4 - 1).alias("confidence_score"),
    )


def messages(tel: DataFrame) -> DataFrame:
    """One message per event, in every shape the stream carries.

    CRITICAL: single ``event``; ERROR: list of one; WARNING: empty list next to an event that must be ignored;
    INFO: list with a NULL entry. Hosts without a name send a wrong key and no id; events without a subtype are
    broken text.
    """
    e = event_struct()
    sev = F.col("severity")
    info = F.struct(
        F.when(F.col("fault_type") != "UNKNOWN", F.col("system_id")).alias("system_id"),
        F.nullif("hostname", F.lit("")).alias("hostname"),
        F.col("memory_usage_percent").cast("double").alias("memory_usage_percent"),
        F.lit("os-1").alias("os_version"),
    )
    listed = (
        F.when(sev == "ERROR", F.array(e))
        .when(sev == "WARNING", F.slice(F.array(e), 1, 0))
        .when(sev == "INFO", F.array(e, F.lit(None)))
    )
    body = F.struct(
        F.when(F.col("hostname") == "", "wrong").otherwise(SECRET).alias("agent_key"),
        F.when(F.col("hostname") != "", F.when(F.col("fault_type") == "UNKNOWN", F.col("system_id"))).alias("system_id"),
        F.nullif("hostname", F.lit("")).alias("hostname"),
        info.alias("system_info"),
        listed.alias("events"),
        F.when(sev.isin("CRITICAL", "WARNING"), e).alias("event"),
    )
    text = F.when(F.col("fault_subtype").isNull(), F.concat(F.lit("broken "), F.col("event_message"))).otherwise(F.to_json(body))
    # The one-element explode keeps the long text expression from being copied into every later filter on it.
    return tel.select(F.explode(F.array(text)).alias("value"), F.col("ingested_at").alias("received_at"), F.col("id").alias("offset"))


def event_xml() -> Column:
    """Event XML: CRITICAL rows carry a rendered message, others four data values, rows without subtype are cut off.

    The record id is missing for App-Host rows.
    """
    system = F.concat(
        F.lit("<System><Provider Name='"), F.col("provider_name"), F.lit("'/><EventID>"), F.col("event_code").cast("string"),
        F.lit("</EventID><Level>"), F.col("level").cast("string"), F.lit("</Level><Task>3</Task><Keywords>0x80ff</Keywords><TimeCreated SystemTime='"),
        F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("'/>"),
        F.when(F.col("provider_name") != "App-Host", F.concat(F.lit("<EventRecordID>"), F.col("id").cast("string"), F.lit("</EventRecordID>"))).otherwise(""),
        F.lit("</System>"),
    )
    data = F.concat(
        F.lit("<EventData><Data Name='a'> "), F.col("fault_type"), F.lit(" </Data><Data>"), F.col("system_id"),
        F.lit("</Data><Data>"), F.col("id").cast("string"), F.lit("</Data><Data>four</Data></EventData>"),
    )
    rendered = F.when(
        F.col("severity") == "CRITICAL", F.concat(F.lit("<RenderingInfo><Message> driver "), F.col("event_message"), F.lit(" </Message></RenderingInfo>"))
    ).otherwise("")
    whole = F.concat(F.lit(f"<Event xmlns='{NS}'>"), system, data, rendered)
    return F.when(F.col("fault_subtype").isNull(), whole).otherwise(F.concat(whole, F.lit("</Event>")))
