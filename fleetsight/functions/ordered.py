"""Ordered operations per key that survive a hot key.

A plain ``Window.partitionBy(host)`` hands all rows of a host to one task. Telemetry is ordered by time, so
these helpers cut each key into time chunks, do the ordered work per (key, chunk), and carry the little that
crosses a chunk border through an aggregate with one row per (key, chunk). Results equal the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chunk(ts: Column, seconds: int) -> Column:
    us = F.unix_micros(ts)
    width = int(seconds) * 1_000_000
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("bigint")


def _keyed(df: DataFrame, keys: list[str], ts: str, chunk_seconds: int) -> DataFrame:
    """Adds ``__key`` and ``__chunk``.

    The keys as one struct are never NULL as a whole, and NULLs inside are equal, so that a plain equi-join, the
    aggregate and the window all share one partitioning by (key, chunk): the rows are shuffled once.
    """
    return df.withColumns({"__key": F.struct(*keys), "__chunk": _chunk(F.col(ts), chunk_seconds)})


def latest_per_key(df: DataFrame, keys: list[str], *order: Column, n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key in the given order.

    Spark plans ``row_number <= n`` with a partial WindowGroupLimit before the shuffle, so a hot key ships at
    most ``n`` rows per map task.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def rank_in_time(
    df: DataFrame, keys: list[str], ts: str, tie: str, chunk_seconds: int = 3600, out: str = "rn", total: str | None = None
) -> DataFrame:
    """``row_number() over (partition by keys order by ts, tie)``, optionally with the row count per key."""
    rows = _keyed(df, keys, ts, chunk_seconds)
    counts = rows.groupBy("__key", "__chunk").agg(F.count(F.lit(1)).alias("__size"))
    per_key = Window.partitionBy("__key")
    earlier = per_key.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("__size").over(per_key))
    joined = rows.join(offsets.drop("__size"), ["__key", "__chunk"], "left")
    local = Window.partitionBy("__key", "__chunk").orderBy(ts, tie)
    return joined.withColumn(out, F.row_number().over(local) + F.col("__offset")).drop("__key", "__chunk", "__offset")


def neighbour_in_time(
    df: DataFrame, keys: list[str], ts: str, tie: str, columns: dict[str, str], chunk_seconds: int = 3600, lead: bool = False
) -> DataFrame:
    """``lag`` (or ``lead``) of several columns: ``columns`` maps the new name to the source column."""
    rows = _keyed(df, keys, ts, chunk_seconds)
    values = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    place = F.struct(F.col(ts), F.col(tie))
    border = (F.min_by if lead else F.max_by)(values, place).alias("__border")
    chunks = rows.groupBy("__key", "__chunk").agg(border)
    over_chunks = Window.partitionBy("__key").orderBy(F.col("__chunk").desc() if lead else F.col("__chunk"))
    chunks = chunks.withColumn("__border", F.lag("__border").over(over_chunks))
    joined = rows.join(chunks, ["__key", "__chunk"], "left")
    order = [F.col(ts).desc(), F.col(tie).desc()] if lead else [F.col(ts), F.col(tie)]
    local = Window.partitionBy("__key", "__chunk").orderBy(*order)
    first = F.row_number().over(local) == 1
    joined = joined.withColumn("__first", first)
    joined = joined.withColumns({f"__l_{out}": F.lag(src).over(local) for out, src in columns.items()})
    picked = {
        out: F.when(F.col("__first"), F.col(f"__border.{out}")).otherwise(F.col(f"__l_{out}")) for out in columns
    }
    return joined.withColumns(picked).drop("__key", "__chunk", "__border", "__first", *[f"__l_{out}" for out in columns])


def trailing_count(
    df: DataFrame, keys: list[str], ts: str, lookback_seconds: int, chunk_seconds: int | None = None, out: str = "recent"
) -> DataFrame:
    """Rows of the same key in ``[ts - lookback, ts]``, equal times included.

    Rows close to the end of a chunk are also sent to the next one as context, which copies at most
    ``lookback / chunk`` of the data.
    """
    chunk_seconds = chunk_seconds or lookback_seconds * 8
    if chunk_seconds < lookback_seconds:
        raise ValueError("a chunk must be at least as long as the lookback")
    us = F.unix_micros(F.col(ts))
    home = _chunk(F.col(ts), chunk_seconds)
    ends = (home + 1) * F.lit(chunk_seconds * 1_000_000)
    near_end = (ends - us) <= F.lit(lookback_seconds * 1_000_000)
    rows = df.withColumn("__us", us).withColumn("__home", home)
    spread = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    rows = rows.withColumn("__chunk", F.explode(spread))
    trailing = Window.partitionBy(*keys, "__chunk").orderBy("__us").rangeBetween(-lookback_seconds * 1_000_000, 0)
    counted = rows.withColumn(out, F.count(F.lit(1)).over(trailing))
    return counted.filter(F.col("__home") == F.col("__chunk")).drop("__us", "__home", "__chunk")


def exact_percentile(df: DataFrame, column: str, fraction: float, bins: int = 10_000, few: int = 100_000) -> float | None:
    """Linear-interpolated percentile of a numeric column, without sorting it in one task.

    A pass counts rows per equal-width bin (at most ``bins`` rows come out); the wanted ranks lie in one or two bins.
    A bin of more than ``few`` rows is cut into bins again, so far outliers, which push nearly all rows into one bin,
    cost passes but never a task with all rows.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return None
    position = fraction * (n - 1)
    lower = int(position)
    found = _at_ranks(values, {lower: lower, min(lower + 1, n - 1): min(lower + 1, n - 1)}, low, high, n, bins, few)
    below, above = found[lower], found[min(lower + 1, n - 1)]
    return float(below + (above - below) * (position - lower))


def _at_ranks(values: DataFrame, ranks: dict[int, int], low: float, high: float, n: int, bins: int, few: int) -> dict[int, float]:
    """The values at some ranks (wanted rank to its rank among the ``n`` rows from ``low`` to ``high``)."""
    if low == high:
        return {r: low for r in ranks}
    inside = values.filter(F.col("v").between(low, high))
    if n <= few:
        ordered = F.sort_array(F.collect_list("v"))
        row = inside.agg(*[F.element_at(ordered, at + 1).alias(str(r)) for r, at in ranks.items()]).first()
        return {r: row[str(r)] for r in ranks}
    # halves keep the width finite for any two doubles
    width = (high / 2 - low / 2) / bins
    place = F.floor((F.col("v") / 2 - F.lit(low / 2)) / F.lit(width)) if width > 0 else F.when(F.col("v") == F.lit(low), 0).otherwise(1)
    counts = inside.groupBy(F.least(place.cast("bigint"), F.lit(bins - 1).cast("bigint")).alias("b"))
    seen, found = 0, {}
    for row in sorted(counts.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["b"]):
        mine = {r: at - seen for r, at in ranks.items() if seen <= at < seen + row["n"]}
        if mine:
            found |= _at_ranks(values, mine, row["lo"], row["hi"], row["n"], bins, few)
        seen += row["n"]
    return found
