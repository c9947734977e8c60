"""Registry of named queries and the column conventions of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.plans.oracle_views import with_views
from fleetsight.sources.adapter import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result types both engines print alike: zone-less timestamps, doubles, bigints, lists joined by ``|``."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with the DuckDB text that checks it."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
