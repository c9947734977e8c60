"""Envelope handling, idempotent append, heartbeats, retention, partitioning, incremental scans, chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.functions.clock import before, shift_month
from fleetsight.functions.coerce import blank_to_null, first_text, number_from_text, whole_from_text
from fleetsight.functions.ordered import latest_per_key, neighbour_in_time, rank_in_time
from fleetsight.operators.shaping import host_metric, prepared_rows
from fleetsight.schemas import COLLECTED_EVENT, ENVELOPE, PERCENT, RETENTION_DAYS


def decode_envelopes(messages: DataFrame, value: str = "value") -> DataFrame:
    """Parse JSON text once, as a VARIANT; rows that are not one whole object are no ``is_object`` and go to the dead-letter output.

    ``msg`` has the fields of the envelope, each read from the parsed value only where it is used; ``msg.events`` and
    ``msg.event`` are VARIANTs. Numbers may come as text. ``NaN`` and single quotes are no JSON.

    The text is read as the first entry of a list whose second is its own hash: text behind the object breaks the list or
    puts something else in that place. The parsed value comes out of a one-element explode: a generator keeps Catalyst
    from copying the parser into every later use.
    """
    raw = F.col(value).cast("string")
    mark = F.xxhash64(raw)
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), mark.cast("string"), F.lit("]")))
    parsed = messages.select("*", F.explode(F.array(listed)).alias("__parsed"))
    whole = raw.rlike(r"^\s*\{") & (F.try_variant_get("__parsed", "$[1]", "bigint") == mark)
    kinds = {"events": "array<variant>", "event": "variant"}

    def read(fields: T.StructType, path: str) -> Column:
        made = []
        for f in fields:
            at = f"{path}.{f.name}"
            nested = isinstance(f.dataType, T.StructType)
            made.append((read(f.dataType, at) if nested else F.try_variant_get("__parsed", at, kinds.get(f.name, f.dataType.simpleString()))).alias(f.name))
        return F.struct(*made)

    return parsed.withColumns({"msg": read(ENVELOPE, "$[0]"), "is_object": F.coalesce(whole, F.lit(False))}).drop("__parsed")


def typed_event(e: Column) -> Column:
    """The fields of one event, a VARIANT, in their declared types; numbers sent as text count, anything else becomes NULL.

    Applied after the list is exploded, so only the fields that are used are read and converted.
    """
    made = []
    for f in COLLECTED_EVENT:
        c = F.try_variant_get(e, f"$.{f.name}", "string")
        if not isinstance(f.dataType, T.StringType):
            c = number_from_text(c) if isinstance(f.dataType, T.DoubleType) else whole_from_text(c, f.dataType)
        made.append(c.alias(f.name))
    return F.struct(*made)


def is_object(e: Column) -> Column:
    """Whether a VARIANT is an object: nothing else can be read as a struct."""
    return F.try_variant_get(e, "$", f"struct<{COLLECTED_EVENT[0].name}:string>").isNotNull()


def dead_letters(decoded: DataFrame) -> DataFrame:
    return decoded.filter(~F.col("is_object"))


def accepted(decoded: DataFrame, secret: str) -> DataFrame:
    """Messages that carry the shared secret."""
    return decoded.filter(F.col("is_object") & (F.coalesce(F.col("msg.agent_key"), F.lit("")) == F.lit(secret)))


def rejected(decoded: DataFrame, secret: str) -> DataFrame:
    return decoded.filter(F.col("is_object") & (F.coalesce(F.col("msg.agent_key"), F.lit("")) != F.lit(secret)))


def message_system() -> Column:
    return F.coalesce(first_text(F.col("msg.system_id"), F.col("msg.system_info.system_id")), F.lit("unknown"))


def message_host() -> Column:
    return F.coalesce(first_text(F.col("msg.hostname"), F.col("msg.system_info.hostname")), F.lit("unknown"))


def identified(decoded: DataFrame) -> DataFrame:
    """Messages with a usable system id."""
    return decoded.withColumn("system_id", message_system()).filter(F.col("system_id") != "unknown").withColumn("hostname", message_host())


def message_events() -> Column:
    """``events`` if it is a list, even an empty one, else ``[event]``, as VARIANTs. Entries may be no object: see ``is_object``."""
    return F.coalesce("msg.events", F.array("msg.event"))


def flatten_events(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per event of an identified message."""
    rows = messages.select(
        "system_id", "hostname", F.col("msg.system_info").alias("system_info"), *keep, F.explode(message_events()).alias("event")
    )
    return rows.where(is_object(F.col("event"))).withColumn("event", typed_event(F.col("event")))


def event_rows(messages: DataFrame, *keep: str) -> DataFrame:
    return prepared_rows(flatten_events(messages, *keep))


def message_heartbeats(messages: DataFrame, time_column: str, *keep: str) -> DataFrame:
    """One heartbeat candidate per message, also for messages without events. ``keep``: columns that break ties later."""
    info, first = F.col("msg.system_info"), typed_event(F.col("first_event"))
    # ``get`` yields NULL past the end, so messages without events fall through to the defaults.
    rows = messages.withColumn("first_event", F.get(F.filter(message_events(), is_object), 0))
    return rows.select(
        "system_id",
        "hostname",
        host_metric(info, first, "cpu_usage_percent", 0).cast(PERCENT).alias("cpu_usage_percent"),
        host_metric(info, first, "memory_usage_percent", 0).cast(PERCENT).alias("memory_usage_percent"),
        host_metric(info, first, "disk_free_percent", 100).cast(PERCENT).alias("disk_free_percent"),
        F.coalesce(info["os_version"], F.col("msg.os_version"), F.lit("Unknown")).alias("os_version"),
        F.coalesce(info["agent_version"], F.col("msg.collector_version"), F.lit("Unknown")).alias("agent_version"),
        F.coalesce(info["ip_address"], F.lit("Unknown")).alias("ip_address"),
        F.coalesce(info["uptime_seconds"], F.col("msg.uptime_seconds"), F.lit(0)).alias("uptime_seconds"),
        F.col(time_column).alias("last_seen"),
        *keep,
    )


def latest_heartbeats(candidates: DataFrame, *tie: str) -> DataFrame:
    """Last message wins per system."""
    return latest_per_key(candidates, ["system_id"], F.col("last_seen").desc(), *[F.col(t).desc() for t in tie])


def unseen_events(rows: DataFrame, order: list[str], hash_column: str = "event_hash", target: DataFrame | None = None) -> DataFrame:
    """First row per hash that the target does not hold yet. Rows without a hash never conflict.

    The partial limit keeps one row per hash and map task, so a hash shared by a third of the rows costs nothing.
    The target is only asked for its hashes.
    """
    hashed = rows.filter(F.col(hash_column).isNotNull())
    first = latest_per_key(hashed, [hash_column], *[F.col(c).asc() for c in order])
    if target is not None:
        known = target.filter(F.col(hash_column).isNotNull()).select(hash_column)
        first = first.join(known, hash_column, "left_anti").select(*rows.columns)
    return first.unionByName(rows.filter(F.col(hash_column).isNull()))


def retained(events: DataFrame, as_of, days: float = RETENTION_DAYS, column: str = "ingested_at") -> DataFrame:
    """Rows inside the retention period; on a month-partitioned table the filter prunes whole partitions."""
    return events.filter(F.col(column) >= before(as_of, days * 86400))


def with_month(events: DataFrame, column: str = "ingested_at") -> DataFrame:
    return events.withColumn("event_month", F.date_format(column, "yyyyMM"))


def month_partitions(events: DataFrame, column: str = "ingested_at") -> DataFrame:
    """Rows per month with the bounds of the month."""
    start = F.date_trunc("month", column)
    return (
        events.groupBy(F.date_format(column, "yyyyMM").alias("event_month"), start.alias("month_start"))
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("month_end", shift_month(F.col("month_start"), 1))
    )


def incremental(records: DataFrame, marks: DataFrame, channel: str = "log_channel", record_id: str = "event_record_id") -> DataFrame:
    """Records above their channel's high-water mark; a channel without one starts at 0."""
    named = marks.select(F.col(channel), F.col("last_record_id"))
    rows = records.join(named, channel, "left")
    return rows.filter(F.col(record_id) > F.coalesce("last_record_id", F.lit(0))).drop("last_record_id")


def new_marks(records: DataFrame, channel: str = "log_channel", record_id: str = "event_record_id") -> DataFrame:
    """Marks to store after the records were delivered."""
    return records.groupBy(channel).agg(F.max(record_id).alias("last_record_id"))


def tail(events: DataFrame, cursor=None, first: int = 50, page: int = 250, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Without a cursor the newest 50 in ascending order, with one the next 250.

    The store of the ingest job has hashed ids, so it is read ``by=("ingested_at", "id")``; the cursor then is that pair of
    the last row read.
    """
    if cursor is None:
        return events.orderBy(*[F.col(c).desc() for c in by]).limit(first).orderBy(*by)
    marks = cursor if isinstance(cursor, tuple) else (cursor,)
    at = [F.lit(m).cast(events.schema[c].dataType) for c, m in zip(by, marks, strict=True)]
    beyond, same = F.lit(False), F.lit(True)
    for c, mark in zip(by, at):
        beyond, same = beyond | (same & (F.col(c) > mark)), same & (F.col(c) == mark)
    # the bound on the first column alone is what the scan can use
    return events.filter((F.col(by[0]) >= at[0]) & beyond).orderBy(*by).limit(page)


def chunk_size(n: Column, base: int = 20, largest: int = 100) -> Column:
    """Batch size for n rows: the base, growing to half the rows, at most ``largest``."""
    return F.when(n <= base, F.lit(base)).otherwise(F.least(F.lit(largest), F.greatest(F.lit(base), F.floor(n / 2))))


def chunked(rows: DataFrame, key: str, ts: str, tie: str, chunk_seconds: int = 3600) -> DataFrame:
    """Adds ``chunk_no`` so that rows of a key form bounded messages in time order."""
    ranked = rank_in_time(rows, [key], ts, tie, chunk_seconds, out="__rn", total="__n")
    size = chunk_size(F.col("__n"))
    return ranked.withColumn("chunk_no", F.floor((F.col("__rn") - 1) / size)).drop("__rn", "__n")


def chunk_messages(chunks: DataFrame, key: str, payload: list[str], tie: str, secret: str | None = None) -> DataFrame:
    """One JSON message per chunk (at most 100 events), keyed for the sink."""
    body = F.sort_array(F.collect_list(F.struct(tie, *[c for c in payload if c != tie])))
    grouped = chunks.groupBy(key, "chunk_no").agg(body.alias("events"))
    fields = [F.col(key).alias("system_id"), F.col("events")]
    if secret is not None:
        fields.append(F.lit(secret).alias("agent_key"))
    return grouped.select(F.col(key).alias("key"), "chunk_no", F.size("events").alias("event_count"), F.to_json(F.struct(*fields)).alias("value"))


def merge_events(current: DataFrame, fresh: DataFrame, keep: int | None = None) -> DataFrame:
    """Union, one row per event_hash (else host, time and code), all of them or the newest ``keep``."""
    both = fresh.withColumn("__src", F.lit(0)).unionByName(current.withColumn("__src", F.lit(1)))
    fallback = F.concat_ws("::", "system_id", F.col("ingested_at").cast("string"), F.col("event_code").cast("string"))
    keyed = both.withColumn("merge_key", F.coalesce(blank_to_null(F.col("event_hash")), fallback))
    # The current row wins over a fresh duplicate.
    unique = latest_per_key(keyed, ["merge_key"], F.col("__src").desc(), F.col("id").asc())
    rows = unique.drop("__src")
    return rows.orderBy(F.col("ingested_at").desc(), F.col("id").desc()).limit(keep) if keep else rows


def merge_snapshots(current: DataFrame, fresh: DataFrame, keep: int | None = None) -> DataFrame:
    """Union, one row per (host, time) with the fresh one winning; all of them or the newest ``keep``."""
    both = fresh.withColumn("__src", F.lit(0)).unionByName(current.withColumn("__src", F.lit(1)))
    unique = latest_per_key(both, ["system_id", "snapshot_time"], F.col("__src").asc())
    rows = unique.drop("__src")
    return rows.orderBy(F.col("snapshot_time").desc(), F.col("system_id")).limit(keep) if keep else rows


def metric_deltas(points: DataFrame, ts: str, tie: str, cpu: float = 5.0, memory: float = 5.0, disk: float = 3.0, chunk_seconds: int = 3600) -> DataFrame:
    """Absolute change against the host's previous reading and whether any change exceeds its threshold.

    The first reading of a host has no predecessor and is never flagged.
    """
    names = {"cpu": "cpu_usage_percent", "memory": "memory_usage_percent", "disk": "disk_free_percent"}
    linked = neighbour_in_time(points, ["system_id"], ts, tie, {f"prev_{k}": c for k, c in names.items()}, chunk_seconds)
    delta = {f"{k}_delta": F.coalesce(F.abs(F.col(c) - F.col(f"prev_{k}")), F.lit(0)) for k, c in names.items()}
    linked = linked.withColumns(delta).drop(*[f"prev_{k}" for k in names])
    flag = (F.col("cpu_delta") > cpu) | (F.col("memory_delta") > memory) | (F.col("disk_delta") > disk)
    return linked.withColumn("changed", flag)


def host_gaps(events: DataFrame, ts: str = "ingested_at", tie: str = "id", chunk_seconds: int = 3600) -> DataFrame:
    """Each event with the time of the same host's previous event (LAG per host)."""
    return neighbour_in_time(events, ["system_id"], ts, tie, {"prev_at": ts}, chunk_seconds)

