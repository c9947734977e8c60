"""The alert state of the stream against the sequential upsert and the batch roll-up."""

import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetsight.operators import alerts
from fleetsight.streaming import alert_state
from tests.test_alert_state import DDL, START, upsert_loop


def made(seed, keys=6):
    rng = random.Random(seed)
    events, acks, ident = {}, {}, 0
    for k in range(keys):
        moments = sorted(rng.sample(range(0, 5000), rng.choice([1, 3, 12, 30])))
        events[f"k{k}"] = [(START + timedelta(minutes=m), ident + i) for i, m in enumerate(moments)]
        ident += len(moments)
        acks[f"k{k}"] = [(START + timedelta(minutes=m, seconds=30), rng.choice([5, 30, 400])) for m in sorted(rng.sample(range(0, 6000), rng.choice([0, 1, 2, 6])))]
    return events, acks


@pytest.mark.parametrize("seed", range(30))
def test_upsert_equals_the_loop(seed):
    events, acks = made(seed)
    for k, seen in events.items():
        rows = [(at, None, *[f"x{e}"] * 10, e) for at, e in seen] + [(at, m, *[None] * 11) for at, m in acks[k]]
        current, done = None, []
        for row in sorted(rows, key=lambda r: (r[0], r[1] is None)):
            before = current
            current, opened = alert_state.upsert(current, row)
            if opened and before:
                done.append(before)
        got = [(r["first_seen_at"], r["last_seen_at"], r["source_event_id"], r["occurrence_count"], r["title"], r["acknowledged_at"], r["suppressed_until"]) for r in [*done, current]]
        want = [(x["first"], x["last"], x["event"], x["n"], "x" + x["title"][1:], x["acked"], x["until"]) for x in upsert_loop(seen, acks[k])]
        assert got == want and [r["episode"] for r in [*done, current]] == list(range(1, len(got) + 1))


COLUMNS = ["alert_key", "episode", "title", "occurrence_count", "first_seen_at", "last_seen_at", "source_event_id", "acknowledged_at", "suppressed_until"]


def frames(spark, events, acks):
    rows = [(k, "native", None, "R", "S", f"h{e}", "ERROR", f"t{e}", "d", None, "{}", e, at) for k, ev in events.items() for at, e in ev]
    log = [(k, at, m) for k, items in acks.items() for at, m in items]
    return spark.createDataFrame(rows, DDL), spark.createDataFrame(log, "alert_key string, acked_at timestamp, cooldown_minutes int")


def test_stream_over_batches_restarts_and_a_replay(spark, tmp_path, few_partitions):
    """Rows out of order inside the delay, a restart between batches, and a batch that runs twice."""
    candidates, acks = frames(spark, *made(11))
    late = frames(spark, {"k9": [(START + timedelta(days=30), 9_000)]}, {})[0]  # lets the watermark pass the rest
    src = str(tmp_path / "in")
    schema = alert_state.keyed_rows(candidates, acks).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        given = stream.where("cooldown is null").withColumnRenamed("at", "seen_at")
        asked = stream.where("cooldown is not null").selectExpr("alert_key", "at as acked_at", "cooldown as cooldown_minutes")
        q = alert_state.start_alert_state(given, asked, str(tmp_path / "out"), str(tmp_path / "cp"), delay="4 days")
        q.awaitTermination(240)

    rows = alert_state.keyed_rows(candidates, acks)
    middle = F.lit(START + timedelta(minutes=2500))
    rows.where(F.col("at") <= middle).orderBy(F.desc("at")).coalesce(1).write.mode("append").parquet(src)
    run()
    rows.where(F.col("at") > middle).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(src)
    alert_state.keyed_rows(late, acks.limit(0)).coalesce(1).write.mode("append").parquet(src)
    run()

    def have():
        table = alert_state.alert_table(spark.read.parquet(str(tmp_path / "out"))).where("alert_key <> 'k9'")
        return sorted(map(tuple, table.select(*COLUMNS).collect()), key=repr)

    want = sorted(map(tuple, alerts.roll_up_with_acks(candidates, acks).select(*COLUMNS).collect()), key=repr)
    assert have() == want
    commits = str(tmp_path / "cp" / "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))
    run()
    assert have() == want


def test_silent_keys_are_forgotten(spark, tmp_path, few_partitions):
    events = {"a": [(START, 1), (START + timedelta(hours=1), 2)], "b": [(START + timedelta(days=9), 3)]}
    later = {"a": [(START + timedelta(days=10), 4)], "b": [(START + timedelta(days=40), 5)]}
    src = str(tmp_path / "in")
    for part in (events, later):
        rows = alert_state.keyed_rows(frames(spark, part, {})[0], frames(spark, {"a": [(START, 1)]}, {"a": [(START, 5)]})[1].limit(0))
        rows.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src).withColumnRenamed("at", "seen_at")
        none = stream.where("false").selectExpr("alert_key", "seen_at as acked_at", "cooldown as cooldown_minutes")
        alert_state.start_alert_state(stream, none, str(tmp_path / "out"), str(tmp_path / "cp"), delay="1 hour", forget_after=timedelta(days=2)).awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out")).where("alert_key = 'a'").orderBy("batch_id").collect()
    assert [(r.episode, r.occurrence_count, r.source_event_id) for r in out] == [(1, 2, 2), (1, 1, 4)]


@pytest.fixture
def few_partitions(spark):
    before, provider = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(alert_state.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set(alert_state.PROVIDER, provider)
