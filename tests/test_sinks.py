"""File sinks and the document reader."""

import glob
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetsight.functions.clock import at
from fleetsight.operators import report, shaping
from fleetsight.sources import sinks


def test_documents(spark, tmp_path):
    doc = {"collector_info": {"version": "1"}, "system_info": {"system_id": "S"}, "last_updated": "t", "events": [{"event_id": 1, "level": 2, "provider_name": "P"}, {"event_id": 2}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    rows = sinks.document_events(sinks.read_documents(spark, str(tmp_path / "a.json"))).orderBy("event_id").collect()
    assert [(r.event_id, r.level, r.system_info.system_id) for r in rows] == [(1, 2, "S"), (2, None, "S")]


def test_broken_document_fails(spark, tmp_path):
    (tmp_path / "b.json").write_text("{not json")
    with pytest.raises(Exception, match="expected a JSON object"):
        sinks.document_events(sinks.read_documents(spark, str(tmp_path / "b.json"))).collect()


def test_rolling_files_hold_at_most_500(spark, tables, tmp_path):
    path = str(tmp_path / "roll")
    sinks.write_rolling_json(tables.tel.coalesce(1), path)
    sizes = [sum(1 for _ in open(f)) for f in glob.glob(f"{path}/*.json")]
    assert sum(sizes) == tables.tel.count() and max(sizes) <= 500


def test_month_store_prunes_folders(spark, tables, tmp_path):
    path = str(tmp_path / "months")
    shifted = tables.tel.unionByName(tables.tel.withColumn("ingested_at", F.add_months("ingested_at", -2).cast("timestamp")))
    sinks.write_months(shifted, path)
    recent = sinks.read_months(spark, path, at(datetime(2024, 1, 1)))
    assert recent.count() == tables.tel.filter(F.col("ingested_at") >= at(datetime(2024, 1, 1))).count()
    assert "event_month" in recent._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    sinks.apply_retention(spark, path, str(tmp_path / "kept"), datetime(2024, 1, 31), 30)
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "kept")).select("event_month").distinct().collect()} == {202401}


def test_appends(spark, tables, tmp_path):
    path = str(tmp_path / "snaps")
    for _ in range(2):
        sinks.append_rows(tables.snaps(), path)
    assert spark.read.parquet(path).count() == 2 * tables.snaps().count()


def test_csv_lines(spark, tables, tmp_path):
    path = str(tmp_path / "csv")
    lines = report.csv_export(shaping.shape_event(tables.tel.withColumn("event_message", F.lit('say "hi"'))))
    sinks.write_lines(lines, "line", path, header="Time,Severity,System,Provider,Fault Type,Message")
    text = spark.read.text(path)
    assert text.count() == tables.tel.count() + 1
    assert text.filter(F.col("value").endswith('"say ""hi"""')).count() == tables.tel.count()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
