"""Messages with bad entries, text numbers and broken JSON."""

import json

import pytest

from fleetsight.operators import ingest

BASE = {"agent_key": "k", "system_id": "S", "hostname": "h"}


def decoded(spark, *values):
    return ingest.decode_envelopes(spark.createDataFrame([(v,) for v in values], "value string"))


def events(spark, body):
    rows = ingest.flatten_events(ingest.identified(decoded(spark, json.dumps(BASE | body))))
    return [r.event for r in rows.collect()]


def test_a_bad_entry_loses_only_itself(spark):
    found = events(spark, {"events": [{"event_record_id": 1}, "junk", 7, None, ["x"], {"event_record_id": 2}]})
    assert [e.event_record_id for e in found] == [1, 2]


def test_numbers_as_text(spark):
    (e,) = events(spark, {"event": {"event_record_id": "7", "cpu_usage_percent": "95", "memory_usage_percent": 3, "event_id": "x", "level": 2, "confidence_score": " .5 "}})
    assert (e.event_record_id, e.cpu_usage_percent, e.memory_usage_percent, e.event_id, e.level, e.confidence_score) == (7, 95.0, 3.0, None, 2, 0.5)


def test_an_object_in_place_of_the_list_falls_to_the_single_event(spark):
    assert [e.event_id for e in events(spark, {"events": {"event_id": 1}, "event": {"event_id": 2}})] == [2]
    assert events(spark, {"events": [], "event": {"event_id": 2}}) == []


@pytest.mark.parametrize("value", ['{"a":1} trailing', '{"a":1', '{"system_id":"S","events":[{"event_id":1}', "[1]", "x", "", None, '{"a":1}}'])
def test_broken_messages_are_dead_letters(spark, value):
    assert ingest.dead_letters(decoded(spark, value)).count() == 1


def test_whole_messages_are_not(spark):
    assert ingest.dead_letters(decoded(spark, " {} ", json.dumps(BASE), '{"text":"a } b {"}')).count() == 0


@pytest.mark.parametrize("value", ['{"a":1},{"b":2}', '{"a":1},5', '{"a":1}] {}', '{"a":1}] {},0]', '{"a":NaN}', "{'a':1}"])
def test_text_around_an_object_is_no_message(spark, value):
    assert ingest.dead_letters(decoded(spark, value)).count() == 1


def test_the_last_of_equal_keys_counts(spark):
    assert decoded(spark, '{"agent_key":"a","agent_key":"b"}').select("msg.agent_key").first()[0] == "b"


def test_each_message_is_parsed_once(spark):
    rows = ingest.flatten_events(ingest.identified(ingest.accepted(decoded(spark, "{}"), "k")))
    plan = rows.select("event.event_id", "event.cpu_usage_percent", "system_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("ParseJson") <= 1 and "from_json" not in plan
