"""Rate-limited resource-change events per host."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.coerce import js_round
from fleetsight.functions.text import resource_hash
from fleetsight.schemas import RESOURCE_EVENT_SECONDS

SEEN_LIMIT = 10_000  # hashes remembered per host
CANDIDATE = "system_id string, ts timestamp, tie bigint, event_hash string, message string"


def change_candidates(deltas: DataFrame, quiet, ts: str = "ingested_at", tie: str = "id") -> DataFrame:
    """Flagged readings of cycles without real events, with hash and message text."""

    def one(name: str):
        return (js_round(F.col(name).cast("double") * 10) / 10).cast("decimal(12,1)").cast("string")

    message = F.concat(
        F.lit("Resource change detected: CPU="), one("cpu_usage_percent"), F.lit("% (Δ"), one("cpu_delta"), F.lit("%) MEM="),
        one("memory_usage_percent"), F.lit("% (Δ"), one("memory_delta"), F.lit("%) DISK_FREE="), one("disk_free_percent"),
        F.lit("% (Δ"), one("disk_delta"), F.lit("%)"),
    )
    rows = deltas.filter(F.col("changed") & quiet)
    hashed = resource_hash(F.col("system_id"), F.col("cpu_usage_percent"), F.col("memory_usage_percent"), F.col("disk_free_percent"))
    return rows.select("system_id", F.col(ts).alias("ts"), F.col(tie).alias("tie"), hashed.alias("event_hash"), message.alias("message"))


def admit(seconds: float, value_hash: str, last: float | None, seen: OrderedDict, every: float) -> bool:
    """One step of the limiter: enough time since the last emitted event and a reading not seen before."""
    if last is not None and seconds - last < every:
        return False
    if value_hash in seen:
        return False
    seen[value_hash] = None
    if len(seen) > SEEN_LIMIT:
        seen.popitem(last=False)
    return True


def rate_limited(candidates: DataFrame, every: float = RESOURCE_EVENT_SECONDS) -> DataFrame:
    """Greedy limiter in time order per host.

    Each emission depends on the one before it, so a host's flagged rows are walked in order; they stream through
    in Arrow batches with one small state, never collected as a group.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, last, seen = None, None, OrderedDict()
        for pdf in batches:
            keep = []
            seconds = pdf["ts"].astype("int64") / (1e9 if str(pdf["ts"].dtype).startswith("datetime64[ns") else 1e6)
            for system, at, value_hash in zip(pdf["system_id"], seconds, pdf["event_hash"]):
                if system != host:
                    host, last, seen = system, None, OrderedDict()
                ok = admit(at, value_hash, last, seen, every)
                if ok:
                    last = at
                keep.append(ok)
            yield pdf[keep]

    ordered = candidates.repartition("system_id").sortWithinPartitions("system_id", "ts", "tie")
    return ordered.mapInPandas(walk, CANDIDATE)
