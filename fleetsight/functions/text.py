"""Message cleaning, byte-safe cuts, hashes and alert keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsight.functions.coerce import first_text, text_or

# Fixed patterns. The second covers Unicode white space plus the four ASCII separators.
TAG = r"<[^>]+>"
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def clean_message(c: Column, max_len: int = 500) -> Column:
    """Tags become spaces, runs of white space one space, then trim and keep ``max_len`` characters."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), TAG, " "), WHITE_SPACE, " ")
    return F.substring(F.trim(spaced), 1, max_len)


def normalized_message(c: Column, max_len: int = 500) -> Column:
    return F.lower(clean_message(c, max_len))


def truncate_utf8(c: Column, max_bytes: int) -> Column:
    """Cut to a byte budget without leaving a broken character (a UTF-8 character has at most 4 bytes)."""
    raw = F.encode(F.coalesce(c, F.lit("")), "UTF-8")

    def valid(n: int) -> Column:
        piece = F.substring(raw, 1, n).cast("string")
        return F.when(F.is_valid_utf8(piece), piece)

    cuts = F.coalesce(*[valid(n) for n in range(max_bytes, max(max_bytes - 4, -1), -1)], F.lit(""))
    return F.when(F.octet_length(raw) <= max_bytes, F.coalesce(c, F.lit(""))).otherwise(cuts)


def sha256(*cs: Column) -> Column:
    return F.sha2(F.concat(*cs), 256)


def event_hash(raw_xml: Column, system_id: Column, record_id: Column) -> Column:
    return sha256(raw_xml, system_id, record_id.cast("string"))


def resource_hash(system_id: Column, cpu: Column, memory: Column, disk: Column) -> Column:
    """Hash of readings rounded to one decimal (half even), so equal readings collapse."""
    one = [F.bround(m.cast("decimal(12,6)"), 1).cast("decimal(12,1)").cast("string") for m in (cpu, memory, disk)]
    return F.sha2(F.concat_ws("::", F.lit("resource"), system_id, *one), 256)


def native_alert_key(system_id: Column, severity: Column, fault: Column, subtype: Column, provider: Column) -> Column:
    return F.sha2(
        F.concat_ws(
            "|",
            F.lit("native"),
            text_or(system_id, "unknown"),
            text_or(severity, "INFO"),
            text_or(fault, "UNKNOWN"),
            text_or(subtype, "UNKNOWN"),
            text_or(provider, "unknown"),
        ),
        256,
    )


def rule_alert_key(rule_id: Column, system_id: Column, severity: Column, fault: Column) -> Column:
    return F.sha2(
        F.concat_ws(
            "|",
            F.lit("rule"),
            F.coalesce(rule_id.cast("string"), F.lit("0")),
            text_or(system_id, "unknown"),
            text_or(severity, "INFO"),
            text_or(fault, "UNKNOWN"),
        ),
        256,
    )


def alert_number(alert_id: Column) -> Column:
    """The number in ``ALERT-<digits>`` (bare digits are accepted too), else NULL."""
    return F.regexp_extract(alert_id, r"^(?:ALERT-)?([0-9]+)$", 1).try_cast("bigint")


def diagnostic_text(diagnostic: Column) -> Column:
    """First non-empty of message, description, summary, error, detail; NULL for anything that is not an object."""
    keys = ("message", "description", "summary", "error", "detail")  # fixed order
    return first_text(*[F.get_json_object(diagnostic, f"$.{k}") for k in keys])


def json_text_map(c: Column) -> Column:
    """JSON object as map<string,string>; anything else becomes an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"}), empty)


def merge_json(base: Column, patch: Column) -> Column:
    """Top-level merge of two JSON objects where the patch wins; values keep their JSON types."""
    empty = F.create_map().cast("map<string,variant>")

    def as_map(c: Column) -> Column:
        return F.coalesce(F.from_json(c, "map<string,variant>", {"mode": "PERMISSIVE"}), empty)

    left, right = as_map(base), as_map(patch)
    kept = F.map_filter(left, lambda k, _v: ~F.map_contains_key(right, k))
    return F.to_json(F.map_concat(kept, right))


def search_any(term: str, *cs: Column) -> Column:
    """Case-insensitive LIKE over several columns; ``%`` and ``_`` in the term act as wildcards."""
    pattern = f"%{term}%"
    hit = F.lit(False)
    for c in cs:
        hit = hit | F.coalesce(c, F.lit("")).ilike(pattern)
    return hit


def contains_any(term: str, *cs: Column) -> Column:
    """Case-insensitive plain substring over several columns."""
    hit = F.lit(False)
    for c in cs:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term.lower()))
    return hit
