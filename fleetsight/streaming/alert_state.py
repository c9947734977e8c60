"""Alert rows kept in the state of a stream, with acknowledgement and suppression (T-6, the live form of A-UPS and A-ACK).

Candidates and acknowledgements are one stream keyed by alert. A row waits in the state of its key until the watermark has
passed it, so rows take effect in event time however the micro-batches fell; a timer per key names the next moment. What
takes effect follows the keyed upsert: a candidate inside a suppression only bumps the current alert, one on an alert
that is not acknowledged refreshes it, any other opens the next episode.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetsight.functions.ordered import latest_per_key
from fleetsight.schemas import ACK_COOLDOWN_MINUTES
from fleetsight.session import ensure_checkpoint_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIXED = ("source_type", "rule_id", "rule_name", "system_id", "hostname", "severity")
FRESH = ("title", "description", "escalation_target", "metadata")



def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_TEXTS = {n: T.LongType() if n == "rule_id" else T.StringType() for n in (*FIXED, *FRESH)} | {"source_event_id": T.LongType()}
#: What waits: an acknowledgement (``cooldown`` not null) or a candidate.
WAITING = _struct(at=T.TimestampType(), cooldown=T.IntegerType(), **_TEXTS)
_TIMES = {n: T.TimestampType() for n in ("first_seen_at", "last_seen_at", "acknowledged_at", "suppressed_until")}
CURRENT = _struct(episode=T.IntegerType(), **_TEXTS, occurrence_count=T.LongType(), **_TIMES)
OUT = _struct(alert_key=T.StringType(), **{f.name: f.dataType for f in CURRENT}, acknowledged=T.BooleanType())
_W = {n: i for i, n in enumerate(WAITING.names)}


def _millis(at: datetime) -> int:
    """The first whole millisecond that is not before ``at``."""
    micros = (at.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return -(-micros // 1000)


def upsert(current: dict | None, row: tuple) -> tuple[dict | None, bool]:
    """The alert after one acknowledgement or candidate, and whether that opened a new episode."""
    at, cooldown = row[_W["at"]], row[_W["cooldown"]]
    if cooldown is not None:
        if current is not None:
            current |= {"acknowledged_at": at, "suppressed_until": at + timedelta(minutes=cooldown)}
        return current, False
    seen = {"last_seen_at": at, "source_event_id": row[_W["source_event_id"]]}
    if current is not None:
        more = seen | {"occurrence_count": current["occurrence_count"] + 1}
        if current["suppressed_until"] is not None and current["suppressed_until"] > at:
            return current | more, False
        if current["acknowledged_at"] is None:
            return current | more | {n: row[_W[n]] for n in FRESH}, False
    new = {n: row[_W[n]] for n in (*FIXED, *FRESH)}
    opened = {"episode": (current["episode"] if current else 0) + 1, "occurrence_count": 1, "first_seen_at": at, "acknowledged_at": None, "suppressed_until": None}
    return new | seen | opened, True


class AlertState(StatefulProcessor):
    """Per alert key: the rows that wait for the watermark, and the current episode."""

    def __init__(self, forget_after: timedelta | None = None) -> None:
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.current = handle.getValueState("current", CURRENT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [tuple(r[n] for n in WAITING.names) for r in rows]
        self.waiting.appendList(fresh)
        self.handle.registerTimer(max(min(_millis(r[0]) for r in fresh), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if _millis(r[0]) <= passed), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[_W["source_event_id"]] or 0))
        rest = [r for r in rows if _millis(r[0]) > passed]
        current = dict(zip(CURRENT.names, self.current.get())) if self.current.exists() else None
        if not due:
            if rest:
                self.handle.registerTimer(min(_millis(r[0]) for r in rest))
            elif current and self.forget_after and _millis(current["last_seen_at"] + self.forget_after) <= passed:
                self.current.clear()
            return iter(())
        changed, told = [], dict(current) if current else None  # a copy, as upsert changes an alert in place
        for row in due:
            if current and self.forget_after and row[0] > current["last_seen_at"] + self.forget_after:
                changed += [current] if current != told else []
                current = None
            before = current
            current, opened = upsert(current, row)
            if opened and before is not None:
                changed.append(before)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(_millis(r[0]) for r in rest))
        else:
            self.waiting.clear()
        made = ({"alert_key": key[0], **e, "acknowledged": e["acknowledged_at"] is not None} for e in (*changed, *([current] if current else ())))
        out = [Row(**{n: e[n] for n in OUT.names}) for e in made]
        if current is None:  # an acknowledgement of a key without an alert
            self.current.clear()
            return iter(out)
        self.current.update(tuple(current[n] for n in CURRENT.names))
        if self.forget_after:
            self.handle.registerTimer(max(_millis(current["last_seen_at"] + self.forget_after), passed + 1))
        return iter(out)

    def close(self) -> None:
        pass


def keyed_rows(candidates: DataFrame, acks: DataFrame, default_cooldown: int = ACK_COOLDOWN_MINUTES) -> DataFrame:
    """Candidates and acknowledgements (alert_key, acked_at[, cooldown_minutes]) as rows of one stream."""
    cooldown = F.coalesce(F.nullif("cooldown_minutes", F.lit(0)), F.lit(default_cooldown)) if "cooldown_minutes" in acks.columns else F.lit(default_cooldown)
    seen = candidates.select("alert_key", F.col("seen_at").alias("at"), F.lit(None).cast("int").alias("cooldown"), *FIXED, *FRESH, "source_event_id")
    return seen.unionByName(acks.select("alert_key", F.col("acked_at").alias("at"), cooldown.cast("int").alias("cooldown")), allowMissingColumns=True)


def alert_state_stream(candidates: DataFrame, acks: DataFrame, delay: str = "10 minutes", forget_after: timedelta | None = None) -> DataFrame:
    """Every change of an alert row: a row per key, episode and change, the newest of them the alert as it stands.

    Rows later than ``delay`` behind the newest are late and left out, as with any watermark; what is younger than ``delay``
    has not taken effect yet. With ``forget_after`` the state of a key that has been silent so long goes, and its next
    alert counts from episode 1. State per key is one row besides what waits.
    """
    rows = keyed_rows(candidates, acks).withWatermark("at", delay)
    return rows.groupBy("alert_key").transformWithState(AlertState(forget_after), OUT, "Append", "EventTime")


def start_alert_state(candidates: DataFrame, acks: DataFrame, out: str, checkpoint: str, once: bool = True, **kw) -> StreamingQuery:
    """Changes to ``out``; each micro-batch overwrites its own partition, so a replayed batch changes nothing."""
    candidates.sparkSession.conf.set(PROVIDER, ROCKSDB)

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    writer = alert_state_stream(candidates, acks, **kw).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def alert_table(changes: DataFrame) -> DataFrame:
    """The alerts as they stand: per key and episode the change of the latest batch, of one batch the one seen last."""
    newest = latest_per_key(changes, ["alert_key", "episode"], F.col("batch_id").desc(), F.col("occurrence_count").desc(), F.col("acknowledged_at").desc_nulls_last())
    return newest.drop("batch_id")


def replayed_alerts(candidates: DataFrame, acks: DataFrame, batches: int = 3) -> DataFrame:
    """Run the stream over recorded candidates and acknowledgements, in slices of time, and return the alerts.

    The slices are files under the shared checkpoint folder; a marker behind the last row lets the watermark pass all.
    """
    spark: SparkSession = candidates.sparkSession
    rows = keyed_rows(candidates, acks)
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return spark.createDataFrame([], OUT)
    local = spark.sparkContext.master.startswith("local[")
    home = f"{ensure_checkpoint_dir(spark, tempfile.gettempdir() if local else None)}/alerts-{uuid.uuid4().hex}"
    width = (high - low) / batches + timedelta(seconds=1)
    for k in range(batches):
        rows.where((F.col("at") >= F.lit(low + k * width)) & (F.col("at") < F.lit(low + (k + 1) * width))).write.mode("append").parquet(f"{home}/in")
    marker = spark.createDataFrame([Row(alert_key="", at=high + 2 * width)]).unionByName(rows.limit(0), allowMissingColumns=True).select(*rows.columns)
    marker.coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", spark.sparkContext.defaultParallelism).parquet(f"{home}/in")
    is_ack = F.col("cooldown").isNotNull()
    given = stream.where(~is_ack).withColumnRenamed("at", "seen_at")
    asked = stream.where(is_ack).select("alert_key", F.col("at").alias("acked_at"), F.col("cooldown").alias("cooldown_minutes"))
    before = spark.conf.get(PROVIDER)
    try:  # a batch may end inside a slice, so rows are late only beyond its width
        start_alert_state(given, asked, f"{home}/out", f"{home}/checkpoint", delay=f"{int(width.total_seconds()) + 1} seconds").awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    layout = T.StructType([*OUT, T.StructField("batch_id", T.LongType())])
    return alert_table(spark.read.schema(layout).parquet(f"{home}/out")).where("alert_key <> ''")
