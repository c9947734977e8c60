"""Event XML: metadata by pattern, description by schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns, one per metadata field. They deliberately keep the known gaps: an element with attributes
# (``<EventID Qualifiers=..>``) is not matched, and a message does not cross lines.
PATTERNS = {
    "event_record_id": r"""EventRecordID["']?>(\d+)<""",
    "provider_name": r"""Provider.*?Name=["']([^"']+)["']""",
    "event_id": r"""EventID["']?>(\d+)<""",
    "level": r"""Level["']?>(\d+)<""",
    "task": r"""Task["']?>(\d+)<""",
    "opcode": r"""Opcode["']?>(\d+)<""",
    "keywords": r"""Keywords["']?>(0x[0-9a-fA-F]+)<""",
    "process_id": r"""ProcessID["']?>(\d+)<""",
    "thread_id": r"""ThreadID["']?>(\d+)<""",
    "event_time": r"""SystemTime=["']([^"']+)["']""",
    "event_message": r"""<Message>(.*?)</Message>""",
}
NUMERIC = {"event_record_id": "bigint", "event_id": "bigint", "level": "bigint", "task": "bigint", "opcode": "bigint", "process_id": "bigint", "thread_id": "bigint"}
DEFAULTS = {"provider_name": "Unknown", "keywords": "0x0", "event_message": ""}

EVENT_XML = "RenderingInfo struct<Message: string>, EventData struct<Data: array<struct<_VALUE: string, _Name: string>>>"


def extract_metadata(rows: DataFrame, xml: str, as_of: Column | None = None) -> DataFrame:
    """Eleven metadata columns; rows without a record id are dropped."""
    c = F.col(xml)
    out = {}
    for name, pattern in PATTERNS.items():
        found = F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
        if name in NUMERIC:
            value = found.try_cast(NUMERIC[name])
            out[name] = value if name == "event_record_id" else F.coalesce(value, F.lit(0).cast(NUMERIC[name]))
        elif name == "event_time":
            out[name] = F.coalesce(found, F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")) if as_of is not None else found
        else:
            out[name] = F.coalesce(found, F.lit(DEFAULTS[name]))
    return rows.withColumns(out).filter(F.col("event_record_id").isNotNull())


def with_description(rows: DataFrame, xml: str, out: str) -> DataFrame:
    """RenderingInfo/Message, else the first three EventData values joined by `` | ``; NULL for broken XML.

    The one-element explode makes sure each text is parsed once, not once per use of the parsed struct.
    """
    text = F.col(xml)
    filled = F.when(F.length(F.trim(text)) > 0, text)
    parsed = F.from_xml(filled, EVENT_XML, {"mode": "PERMISSIVE", "ignoreNamespace": "true", "valueTag": "_VALUE"})
    e = F.col("__xml")
    first_three = F.slice(e["EventData"]["Data"], 1, 3)
    # Elements without text are skipped after the cut to three, not before it.
    texts = F.filter(F.transform(first_three, lambda d: F.trim(d["_VALUE"])), lambda t: t.isNotNull())
    joined = F.nullif(F.array_join(texts, " | "), F.lit(""))
    opened = rows.select("*", F.explode(F.array(parsed)).alias("__xml"))
    return opened.withColumn(out, F.coalesce(F.trim(e["RenderingInfo"]["Message"]), joined)).drop("__xml")
