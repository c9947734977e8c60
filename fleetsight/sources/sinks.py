"""Batch sinks and the reader for collected-events documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.functions.clock import before
from fleetsight.operators.ingest import with_month
from fleetsight.schemas import COLLECTED_EVENT, SYSTEM_INFO

EVENTS_PER_FILE = 500

DOCUMENT = T.StructType(
    [
        T.StructField("collector_info", T.MapType(T.StringType(), T.StringType())),
        T.StructField("system_info", SYSTEM_INFO),
        T.StructField("last_updated", T.StringType()),
        T.StructField("events", T.ArrayType(COLLECTED_EVENT)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Collected-events documents, one row per file, with a declared schema. A file that is not a JSON object fails."""
    raw = spark.read.schema(DOCUMENT).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    bad = F.col("_corrupt_record").isNotNull()
    checked = F.when(bad, F.raise_error(F.lit("expected a JSON object with an events list"))).otherwise(F.col("events"))
    return raw.withColumn("events", checked).drop("_corrupt_record")


def document_events(documents: DataFrame) -> DataFrame:
    """One row per event of the documents."""
    return documents.select("system_info", "last_updated", F.explode("events").alias("event")).select("system_info", "last_updated", "event.*")


def write_rolling_json(events: DataFrame, path: str, per_file: int = EVENTS_PER_FILE) -> None:
    """JSON lines, at most ``per_file`` events per file."""
    events.write.mode("append").option("maxRecordsPerFile", per_file).json(path)


def write_months(events: DataFrame, path: str, mode: str = "append") -> None:
    """Event store partitioned by month.

    The rebalance hint lets AQE cut a large month into many tasks and files of the advisory size and merge small
    ones, so neither a hot month nor a short tail needs a hand-set number.
    """
    with_month(events).hint("rebalance", "event_month").write.mode(mode).partitionBy("event_month").parquet(path)


def read_months(spark: SparkSession, path: str, since: Column | None = None, column: str = "ingested_at") -> DataFrame:
    """Read the event store; a lower time bound also prunes the month folders."""
    rows = spark.read.parquet(path).withColumn("event_month", F.col("event_month").cast("string"))
    if since is None:
        return rows
    return rows.filter((F.col(column) >= since) & (F.col("event_month") >= F.date_format(since, "yyyyMM")))


def apply_retention(spark: SparkSession, path: str, out: str, as_of, days: float) -> None:
    """Write the rows inside the retention period to a new folder; whole expired months are never read."""
    read_months(spark, path, before(as_of, days * 86400)).write.mode("overwrite").partitionBy("event_month").parquet(out)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append snapshot or prediction rows."""
    rows.write.mode("append").parquet(path)


def write_lines(lines: DataFrame, column: str, path: str, header: str | None = None) -> None:
    """Text output, one line per row. The header, if any, is a file of its own that sorts first."""
    if header is not None:
        lines.sparkSession.createDataFrame([(header,)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
        lines.select(column).write.mode("overwrite").text(f"{path}/part=1")
    else:
        lines.select(column).write.mode("overwrite").text(path)


def write_messages(messages: DataFrame, servers: str, topic: str) -> None:
    """Keyed messages to Kafka (needs the Kafka connector on the cluster)."""
    messages.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
