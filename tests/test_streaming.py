"""Streams run to completion over files give what the batch operators give."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetsight.operators import alerts, ingest, resource_events, shaping
from fleetsight.plans.derived import SECRET, messages
from fleetsight.streaming import jobs, sources


@pytest.fixture(scope="module", autouse=True)
def few_state_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def message_dir(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("msgs") / "in")
    m = messages(tables.tel)
    m.unionByName(m.filter(F.col("offset") % 5 == 0)).repartition(4).write.parquet(path)  # some messages arrive twice
    return path


@pytest.fixture(scope="module")
def event_dir(tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tel") / "in")
    tables.tel.repartition(3).write.parquet(path)
    return path


def to_table(spark, stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name)


def test_event_ingest_equals_batch(spark, tables, message_dir, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        stream = sources.file_messages(spark, message_dir, max_files=2)
        jobs.start_event_ingest(stream, SECRET, out, str(tmp_path / "cp")).awaitTermination(240)
    got = spark.read.parquet(f"{out}/events")
    batch = ingest.event_rows(ingest.identified(ingest.accepted(ingest.decode_envelopes(messages(tables.tel)), SECRET)))
    cols = ["event_record_id", "system_id", "parsed_message", "fault_subtype", "cpu_usage_percent"]
    assert sorted(got.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    assert {r[0] for r in got.select("event_month").distinct().collect()} == {202401}
    severe = batch.filter(F.col("severity").isin("CRITICAL", "ERROR", "WARNING")).count()
    assert spark.read.parquet(f"{out}/candidates").count() == severe


def test_ingest_fires_rules_over_several_batches(spark, tables, message_dir, tmp_path):
    """Rule counts reach back into earlier batches, and a replayed batch changes nothing."""
    out = str(tmp_path / "out")
    rule = spark.createDataFrame([(1, "Errors", "severity = ERROR", "ERROR", 1, 30, None, True)], tables.rules.schema)
    stream = sources.file_messages(spark, message_dir, max_files=1)
    jobs.start_event_ingest(stream, SECRET, out, str(tmp_path / "cp"), rules=rule, lookback_seconds=3600).awaitTermination(240)
    events = spark.read.parquet(f"{out}/events")
    assert events.select("batch_id").distinct().count() > 1
    assert events.select("id").distinct().count() == events.count()
    got = spark.read.parquet(f"{out}/candidates").groupBy("source_type").count().collect()
    native = events.filter(F.col("severity").isin("CRITICAL", "ERROR", "WARNING")).count()
    assert {r[0]: r[1] for r in got} == {"native": native, "rule": events.filter("severity = 'ERROR'").count()}
    live = jobs.alert_rows(spark.read.parquet(f"{out}/alert_deltas"))
    want = alerts.roll_up(spark.read.parquet(f"{out}/candidates"))
    cols = ["alert_key", "severity", "title", "occurrence_count", "first_seen_at", "last_seen_at", "source_event_id"]
    assert sorted(live.select(*cols).collect()) == sorted(want.select(*cols).collect())
    jobs._write_batch(ingest.with_month(events.filter("batch_id = 1").drop("event_month", "batch_id")), f"{out}/copy", 1, "event_month")
    jobs._write_batch(ingest.with_month(events.filter("batch_id = 1").drop("event_month", "batch_id")), f"{out}/copy", 1, "event_month")
    assert spark.read.parquet(f"{out}/copy").count() == events.filter("batch_id = 1").count()
    page = ingest.tail(events, by=("ingested_at", "id")).collect()
    assert len(page) == 50
    newer = ingest.tail(events, (page[10].ingested_at, page[10].id), by=("ingested_at", "id")).collect()
    assert [r.id for r in newer] == [r.id for r in page[11:]]


def test_kafka_rows(spark):
    """Offsets repeat across partitions; the place of a message has all three parts."""
    schema = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
    text = b'{"agent_key": "%s", "system_id": "S", "events": [{"severity": "ERROR"}]}' % SECRET.encode()
    at = datetime(2024, 1, 1)
    records = spark.createDataFrame([(None, bytearray(text), "t", p, 7, at, 0) for p in (0, 1)], schema)
    rows = sources.kafka_rows(records)
    assert rows.columns == ["value", "received_at", "topic", "partition", "offset"]
    assert jobs.event_stream(rows, SECRET).count() == 2
    assert jobs.heartbeat_stream(rows, SECRET).columns[0] == "system_id" and jobs.heartbeat_stream(rows, SECRET).count() == 1


def test_dead_letters(spark, tables, message_dir, tmp_path):
    out = str(tmp_path / "dlq")
    jobs.start_dead_letters(sources.file_messages(spark, message_dir), out, str(tmp_path / "cp")).awaitTermination(240)
    want = tables.tel.filter("fault_subtype IS NULL").count()
    assert spark.read.parquet(out).select("offset").distinct().count() == want


def test_heartbeats(spark, tables, message_dir, tmp_path):
    got = to_table(spark, jobs.heartbeat_stream(sources.file_messages(spark, message_dir), SECRET), "hbs", "complete", tmp_path)
    decoded = ingest.identified(ingest.accepted(ingest.decode_envelopes(messages(tables.tel)), SECRET))
    want = ingest.latest_heartbeats(ingest.message_heartbeats(decoded, "received_at"))
    cols = ["system_id", "hostname", "cpu_usage_percent", "last_seen"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_live_windows(spark, tables, event_dir, tmp_path):
    ddl = tables.tel.schema
    stream = spark.readStream.schema(ddl).parquet(event_dir)
    got = to_table(spark, jobs.metric_stream(stream, delay="60 days"), "mets", "complete", tmp_path)
    want = jobs.metric_stream(tables.tel)
    assert sorted(got.select("bucket", "event_count", "critical_count").collect()) == sorted(want.select("bucket", "event_count", "critical_count").collect())
    live = to_table(spark, jobs.signal_stream(spark.readStream.schema(ddl).parquet(event_dir), delay="60 days"), "sigs", "update", tmp_path)
    assert live.count() == jobs.signal_stream(tables.tel).count()


def test_snapshot_stream(spark, tables, event_dir, tmp_path):
    stream = spark.readStream.schema(tables.tel.schema).parquet(event_dir)
    got = to_table(spark, jobs.snapshot_stream(stream, "1 day", "1 day", "60 days"), "snp", "complete", tmp_path)
    cols = ["system_id", "snapshot_time", "total_events", "dominant_fault_type", "avg_confidence"]
    assert sorted(got.select(*cols).collect()) == sorted(tables.snaps().select(*cols).collect())


def test_recent_unique(spark, tables, event_dir, tmp_path):
    stream = spark.readStream.schema(tables.tel.schema).parquet(event_dir).withColumn("event_hash", F.concat("system_id", "fault_type"))
    got = to_table(spark, jobs.recent_unique(stream, "60 days"), "uniq", "append", tmp_path)
    assert got.count() == tables.tel.select("system_id", "fault_type").distinct().count()


def test_alert_state_equals_batch(spark, tables, tmp_path):
    path = str(tmp_path / "cand")
    candidates = alerts.native_candidates(tables.tel)
    candidates.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(candidates.schema).option("maxFilesPerTrigger", 1).parquet(path)
    updates = to_table(spark, jobs.alert_stream(stream), "alrt", "update", tmp_path)
    final = updates.groupBy("alert_key").agg(F.max_by(F.struct("occurrence_count", "first_seen_at", "last_seen_at", "source_event_id", "title"), "occurrence_count").alias("x")).select("alert_key", "x.*")
    want = alerts.roll_up(candidates).select(*final.columns)
    assert sorted(final.collect()) == sorted(want.collect())


def test_resource_events_equal_batch(spark, tables, tmp_path):
    deltas = ingest.metric_deltas(tables.tel, "ingested_at", "id")
    rows = resource_events.change_candidates(deltas, F.col("severity") == "INFO")
    path = str(tmp_path / "cand")
    rows.coalesce(1).write.parquet(path)
    got = to_table(spark, jobs.resource_event_stream(spark.readStream.schema(rows.schema).parquet(path), 3600), "res", "append", tmp_path)
    want = resource_events.rate_limited(rows, 3600)
    assert {r.tie for r in got.collect()} == {r.tie for r in want.collect()}


def test_liveness_reports_online(spark, tables, tmp_path):
    path = str(tmp_path / "hb")
    tables.hb.write.parquet(path)
    stream = spark.readStream.schema(tables.hb.schema).parquet(path)
    got = to_table(spark, jobs.liveness_stream(stream, 3600), "live", "update", tmp_path)
    assert {r.status for r in got.collect()} == {"online"} and got.count() == tables.hb.count()
    assert shaping.liveness(tables.hb, tables.as_of).filter("is_alive").count() <= got.count()


def test_observed_counters_and_lag(spark, tables, message_dir, tmp_path):
    monitor = jobs.BatchMonitor()
    spark.streams.addListener(monitor)
    try:
        to_table(spark, jobs.observed(sources.file_messages(spark, message_dir), SECRET).select("offset"), "obs", "append", tmp_path)
        expected = spark.read.parquet(message_dir).count()
        deadline = time.monotonic() + 60
        while sum(b["observed"].get("ingest", {}).get("messages", 0) for b in monitor.batches) < expected and time.monotonic() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(monitor)
    totals = [b["observed"].get("ingest", {}) for b in monitor.batches]
    assert sum(t.get("messages", 0) for t in totals) == spark.read.parquet(message_dir).count()
    progress = {"sources": [{"endOffset": {"t": {"0": 10, "1": 5}}, "latestOffset": {"t": {"0": 200, "1": 90}}}]}
    assert jobs.source_lag(progress) == {"total_lag": 275, "max_partition_lag": 190, "status": "warning"}
    assert jobs.source_lag({"sources": []})["status"] == "ok"
