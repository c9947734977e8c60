"""Grouped signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.clock import age_label, at, before, seconds_between, time_bucket
from fleetsight.functions.severity import severity_name, severity_rank
from fleetsight.operators.shaping import host_label

SIGNAL_SECONDS = 120
RETAIN_SECONDS = 24 * 3600
SPIKE = 3


def group_signals(
    events: DataFrame, as_of, bucket_seconds: int = SIGNAL_SECONDS, retain_seconds: float = RETAIN_SECONDS, time: str = "ingested_at"
) -> DataFrame:
    """Events per (host, fault, subtype, time bucket): worst severity, count, host names, first, last, spike flag.

    One hash aggregate. ``systems`` holds the distinct host names one system used inside one bucket, so its size
    does not grow with the data.
    """
    recent = events.filter(F.col(time) > before(as_of, retain_seconds))
    grouped = recent.groupBy(
        "system_id",
        "fault_type",
        F.coalesce("fault_subtype", F.lit("general")).alias("fault_subtype"),
        time_bucket(F.col(time), bucket_seconds).alias("bucket"),
    ).agg(
        severity_name(F.greatest(F.lit(1), F.max(severity_rank(F.col("severity"))))).alias("severity"),
        F.count(F.lit(1)).alias("count"),
        F.sort_array(F.collect_set(host_label())).alias("systems"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        F.max(F.coalesce("confidence_score", F.lit(0))).alias("max_confidence"),
    )
    bucket_no = (F.unix_micros("bucket") / F.lit(bucket_seconds * 1_000_000)).cast("bigint").cast("string")
    return grouped.withColumns(
        {
            "signal_id": F.concat_ws("::", "system_id", "fault_type", "fault_subtype", bucket_no),
            "is_spike": F.col("count") >= SPIKE,
            "age": age_label(seconds_between(at(as_of), F.col("last_seen"))),
        }
    )


def ordered_signals(signals: DataFrame) -> DataFrame:
    return signals.orderBy(F.col("last_seen").desc(), severity_rank(F.col("severity")).desc(), "signal_id")
