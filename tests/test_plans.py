"""Plan shape: pushed filters, pruned columns, no cross joins, partial limits, one scan where one is enough."""

import pytest

from fleetsight.plans.catalog import QUERIES

from conftest import SMALL


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["j06_rule_matches", "a_ups_alerts_with_acks", "j15_incident_timeline", "a23_kpi_strip", "c06_correlations", "j14_incident_correlations", "a08_export_totals", "p25_suggested_actions"]
)
def test_no_cross_or_nested_loop_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["a02_metrics_last_6h", "a03_kpis", "a10_mean_gap", "s08_retained_events", "a20_health_scores", "a09_throughput"])
def test_time_window_reaches_the_scan(spark, name):
    text = plan(spark, name)
    assert "GreaterThan(ts," in text or "GreaterThanOrEqual(ts," in text


def test_scan_reads_only_needed_columns(spark):
    assert "ReadSchema: struct<ts:timestamp,user_id:bigint>" in plan(spark, "a10_mean_gap").replace("\n", "")


@pytest.mark.parametrize("name", ["w03_latest_predictions", "w08_prediction_history", "s05_unseen_documents", "w05_newest_per_alert_key", "j15_incident_timeline"])
def test_top_n_per_key_is_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["w01_host_gaps", "w06_metric_deltas", "s16_chunk_rows", "j07_recent_matches"])
def test_ordered_operators_split_keys_by_time(spark, name):
    """The window over the data is partitioned by (key, chunk); nothing is sent to a single partition."""
    text = plan(spark, name)
    assert "__chunk" in text and "Exchange SinglePartition" not in text


@pytest.mark.parametrize("name", ["w02_stream_gaps", "a11_minute_trend"])
def test_global_order_only_gathers_chunk_borders(spark, name):
    """Without a key the one gathered input is the table of chunk borders: an aggregate with a row per chunk."""
    text = plan(spark, name)
    assert text.count("Exchange SinglePartition") == 1
    below = text.split("Exchange SinglePartition")[1].splitlines()[1]
    assert "Aggregate(key=" in below and "__chunk" in below


def test_newest_n_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(spark, "p01_event_search")


def test_report_counters_scan_once(spark):
    assert plan(spark, "a13_report_counters").count("FileScan") == 1


def test_feature_statistics_hash_aggregate_the_data(spark):
    """The pass over the events is a hash aggregate; sorting is left to the small second level."""
    text = plan(spark, "a01_feature_stats_all_hosts")
    scan_side = text.split("Exchange")[-1]
    assert "HashAggregate" in scan_side and "SortAggregate" not in scan_side and "ObjectHashAggregate" not in scan_side


def test_windowed_snapshots_hash_aggregate_the_data(spark):
    """Snapshots carry the newest readings too; still no map task sorts the events."""
    text = plan(spark, "t03_windowed_snapshots") if "t03_windowed_snapshots" in QUERIES else plan(spark, "p23_read_snapshots")
    scan_side = text.split("Exchange")[-1]
    assert "HashAggregate" in scan_side and "SortAggregate" not in scan_side and "ObjectHashAggregate" not in scan_side
