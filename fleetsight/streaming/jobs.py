"""Streaming jobs. All keep their state in checkpoints, so a lost executor or driver resumes where it was."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from fleetsight.operators import alerts, ingest, resource_events
from fleetsight.operators.features import stat_columns
from fleetsight.operators.metrics import severity_counts
from fleetsight.operators.shaping import host_label
from fleetsight.schemas import RULE_LOOKBACK_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAG_WARNING = 250


def use_rocksdb(spark: SparkSession) -> None:
    """Keep keyed state off the heap; needed once the number of keys is large."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


# ---------------------------------------------------------------- ingest


def source_place(messages: DataFrame) -> list[str]:
    """Columns that name a message's place in its source, most significant first."""
    return [c for c in ("topic", "partition", "offset") if c in messages.columns]


def event_stream(messages: DataFrame, secret: str) -> DataFrame:
    """Decoded, gated, flattened and de-duplicated events.

    A hash is let through once, for good, as a unique constraint would; events without a hash get a key from
    their message (topic, partition and offset, as far as the source has them) and place, so they never collide. The
    state is partitioned by hash.
    """
    place = source_place(messages)
    good = ingest.identified(ingest.accepted(ingest.decode_envelopes(messages), secret))
    flat = good.select(
        "system_id", "hostname", F.col("msg.system_info").alias("system_info"), F.col("received_at").alias("ingested_at"), *place,
        F.posexplode(ingest.message_events()).alias("position", "event"),
    ).where(ingest.is_object(F.col("event"))).withColumn("event", ingest.typed_event(F.col("event")))
    own = F.concat_ws(":", F.lit("no-hash"), "system_id", *[F.col(c).cast("string") for c in (*place, "position")])
    return flat.withColumn("dedupe_key", F.coalesce("event.event_hash", own)).dropDuplicates(["dedupe_key"])


def start_event_ingest(
    messages: DataFrame, secret: str, out: str, checkpoint: str, once: bool = True, rules: DataFrame | None = None, lookback_seconds: int = RULE_LOOKBACK_SECONDS
) -> StreamingQuery:
    """Events, alert candidates (native, and of ``rules`` if given) and their alert rows per micro-batch.

    Each batch overwrites its own partitions (month and batch, by dynamic overwrite), so a replayed batch does not
    append twice. Rules count their matches over the stored events of the lookback as well. ``alert_deltas`` holds one
    row per alert key and batch; ``alert_rows`` sums them up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # the key of an event is its hash, or its place in the source: ids of events without a hash differ too
        rows = ingest.prepared_rows(batch).withColumn("id", F.xxhash64("dedupe_key")).drop("dedupe_key")
        rows = rows.persist()
        try:
            candidates = alerts.native_candidates(rows)
            if rules is not None:
                seen = _with_history(rows, f"{out}/events", batch_id, lookback_seconds)
                fired = alerts.rule_candidates(seen, rules, lookback_seconds)
                fresh = rows.select(F.col("id").alias("source_event_id"))
                candidates = candidates.unionByName(fired.join(fresh, "source_event_id", "left_semi").select(*candidates.columns))
            _write_batch(ingest.with_month(rows), f"{out}/events", batch_id, "event_month")
            _write_batch(candidates, f"{out}/candidates", batch_id)
            _write_batch(alerts.roll_up(candidates), f"{out}/alert_deltas", batch_id)
        finally:
            rows.unpersist()

    return _start(event_stream(messages, secret).writeStream.foreachBatch(write), checkpoint, once)


def _write_batch(rows: DataFrame, path: str, batch_id: int, *above: str) -> None:
    placed = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*above, "batch_id").parquet(path)


def _with_history(rows: DataFrame, path: str, batch_id: int, lookback_seconds: int) -> DataFrame:
    """A batch and the stored events of earlier batches that its lookback reaches; month folders outside are not read."""
    oldest = rows.agg(F.min("ingested_at")).first()[0]
    if batch_id == 0 or oldest is None:
        return rows
    since = F.lit(oldest) - F.make_dt_interval(secs=F.lit(lookback_seconds))
    layout = T.StructType([*rows.schema.fields, T.StructField("event_month", T.StringType()), T.StructField("batch_id", T.LongType())])
    stored = rows.sparkSession.read.schema(layout).parquet(path)
    near = (F.col("event_month") >= F.date_format(since, "yyyyMM")) & (F.col("ingested_at") >= since)
    return rows.unionByName(stored.filter(near & (F.col("batch_id") < batch_id)).select(*rows.columns))


def alert_rows(deltas: DataFrame) -> DataFrame:
    """The alert per key from the rows per key and batch."""
    first, last = F.struct("first_seen_at", "batch_id"), F.struct("last_seen_at", "source_event_id")
    fixed = ("source_type", "rule_id", "rule_name", "system_id", "hostname", "severity")
    fresh = ("title", "description", "escalation_target", "metadata", "source_event_id")
    grouped = deltas.groupBy("alert_key").agg(
        F.min_by(F.struct(*fixed), first).alias("first"), F.max_by(F.struct(*fresh), last).alias("last"),
        F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )
    return grouped.select("alert_key", "first.*", "last.*", "occurrence_count", "first_seen_at", "last_seen_at")


def start_dead_letters(messages: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Messages that are not JSON objects, kept as they came."""
    bad = ingest.dead_letters(ingest.decode_envelopes(messages)).select("value", "received_at", "offset")
    return _start(bad.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, once)


def heartbeat_stream(messages: DataFrame, secret: str) -> DataFrame:
    """Newest heartbeat per system; one row of state per system."""
    good = ingest.identified(ingest.accepted(ingest.decode_envelopes(messages), secret))
    place = source_place(messages)
    candidates = ingest.message_heartbeats(good, "received_at", *place)
    values = F.struct(*[c for c in candidates.columns if c not in ("system_id", *place)])
    # of messages received at one time the later in the source wins, in a re-run as well
    newest = candidates.groupBy("system_id").agg(F.max_by(values, F.struct("last_seen", *place)).alias("h"))
    return newest.select("system_id", "h.*")


# ---------------------------------------------------------------- live windows


def signal_stream(events: DataFrame, bucket: str = "2 minutes", delay: str = "10 minutes") -> DataFrame:
    """Signals per (host, fault, subtype, bucket) in event time."""
    rows = events.withWatermark("ingested_at", delay)
    grouped = rows.groupBy(
        F.window("ingested_at", bucket), "system_id", "fault_type", F.coalesce("fault_subtype", F.lit("general")).alias("fault_subtype")
    ).agg(
        F.count(F.lit(1)).alias("count"),
        F.max("ingested_at").alias("last_seen"),
        F.sort_array(F.collect_set(host_label())).alias("systems"),
    )
    return grouped.select(F.col("window.start").alias("bucket"), "system_id", "fault_type", "fault_subtype", "count", (F.col("count") >= 3).alias("is_spike"), "last_seen", "systems")


def metric_stream(events: DataFrame, bucket: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts per severity and bucket, live."""
    rows = events.withWatermark("ingested_at", delay)
    grouped = rows.groupBy(F.window("ingested_at", bucket)).agg(F.count(F.lit(1)).alias("event_count"), *severity_counts())
    return grouped.withColumn("bucket", F.col("window.start")).drop("window")


def snapshot_stream(events: DataFrame, lookback: str = "30 seconds", interval: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Feature statistics per host for every (sliding) window."""
    rows = events.withWatermark("ingested_at", delay)
    grouped = rows.groupBy("system_id", F.window("ingested_at", lookback, interval)).agg(*stat_columns())
    return grouped.withColumn("snapshot_time", F.col("window.start")).drop("window")


def recent_unique(events: DataFrame, delay: str = "1 hour", key: str = "event_hash") -> DataFrame:
    """De-duplication with bounded memory: a hash is forgotten once the watermark has passed it."""
    return events.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark([key])


# ---------------------------------------------------------------- keyed state


def resource_event_stream(candidates: DataFrame, every: float = resource_events.RESOURCE_EVENT_SECONDS) -> DataFrame:
    """The rate limiter over a stream: last emission and recent hashes per host are the state."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, hashes = (None, []) if not state.exists else state.get
        last = None if last is None or last < 0 else last
        seen = OrderedDict.fromkeys(hashes)
        rows = pd.concat(list(batches)).sort_values(["ts", "tie"])
        keep = []
        for moment, value_hash in zip(rows["ts"], rows["event_hash"]):
            ok = resource_events.admit(moment.timestamp(), value_hash, last, seen, every)
            last = moment.timestamp() if ok else last
            keep.append(ok)
        state.update((-1.0 if last is None else last, list(seen)))
        yield rows[keep]

    return candidates.groupBy("system_id").applyInPandasWithState(
        step, resource_events.CANDIDATE, "last double, hashes array<string>", "append", "NoTimeout"
    )


def alert_stream(candidates: DataFrame) -> DataFrame:
    """Active alert per key, updated by each batch of candidates: one streaming aggregate, one row of state per key."""
    place = F.struct("seen_at", "source_event_id")
    grouped = candidates.groupBy("alert_key").agg(
        F.max_by(F.struct("severity", "title", "source_event_id"), place).alias("last"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
    )
    return grouped.select("alert_key", "last.severity", "last.title", "occurrence_count", "first_seen_at", "last_seen_at", "last.source_event_id")


def liveness_stream(heartbeats: DataFrame, offline_seconds: int = 120) -> DataFrame:
    """``online`` when a host reports, ``offline`` once it has been silent for the timeout (processing time)."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"system_id": [key[0]], "status": ["offline"], "last_seen": [last]})
            return
        last = max(pdf["last_seen"].max() for pdf in batches)
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        state.setTimeoutDuration(offline_seconds * 1000)
        yield pd.DataFrame({"system_id": [key[0]], "status": ["online"], "last_seen": [last]})

    return heartbeats.select("system_id", "last_seen").groupBy("system_id").applyInPandasWithState(
        step, "system_id string, status string, last_seen timestamp", "last timestamp", "update", "ProcessingTimeTimeout"
    )


# ---------------------------------------------------------------- observability


def observed(messages: DataFrame, secret: str, name: str = "ingest") -> DataFrame:
    """Decoded messages with counters attached to every micro-batch."""
    decoded = ingest.decode_envelopes(messages)
    wrong_key = F.coalesce(F.col("msg.agent_key"), F.lit("")) != secret
    return decoded.observe(
        name,
        F.count(F.lit(1)).alias("messages"),
        F.count_if(~F.col("is_object")).alias("dead_letters"),
        F.count_if(F.col("is_object") & wrong_key).alias("rejected"),
    )


def source_lag(progress: dict, warning: int = LAG_WARNING) -> dict:
    """Total and largest per-partition lag from a progress report's offsets, with its status."""
    lags = []
    for source in progress.get("sources", []):
        end, latest = source.get("endOffset") or {}, source.get("latestOffset") or {}
        if isinstance(end, dict) and isinstance(latest, dict):
            for topic, parts in latest.items():
                if isinstance(parts, dict):
                    lags += [max(0, int(v) - int(end.get(topic, {}).get(p, 0))) for p, v in parts.items()]
    total = sum(lags)
    return {"total_lag": total, "max_partition_lag": max(lags, default=0), "status": "warning" if total >= warning else "ok"}


class BatchMonitor(StreamingQueryListener):
    """Rate, observed counters and lag of the newest ``keep`` micro-batches."""

    def __init__(self, keep: int = 1000) -> None:
        self.batches: deque[dict] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counters = {k: v.asDict() for k, v in (p.observedMetrics or {}).items()}
        self.batches.append(
            {"batch_id": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "observed": counters}
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
