"""Streaming sources. Every source yields ``value`` (JSON text), ``received_at`` and ``offset``, Kafka also its topic and partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_DDL = "value string, received_at timestamp, offset bigint"


def kafka_messages(spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int = 50_000, **options: str) -> DataFrame:
    """Kafka topic from the earliest offset; progress lives in the query's checkpoint."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("failOnDataLoss", "true")
        .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    return kafka_rows(reader.load())


def kafka_rows(records: DataFrame) -> DataFrame:
    """The columns of a message from records with Kafka's schema; an offset is unique only with topic and partition."""
    return records.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("received_at"), "topic", "partition", "offset")


def file_messages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Message files (Parquet with the three columns)."""
    return spark.readStream.schema(MESSAGE_DDL).option("maxFilesPerTrigger", max_files).parquet(path)


def file_rows(spark: SparkSession, path: str, ddl: str, max_files: int = 100) -> DataFrame:
    """Parquet files of any declared schema as a stream."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", max_files).parquet(path)
