"""Chunked ordered operators against plain windows, with one key that holds a third of the rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetsight.functions.ordered import exact_percentile, latest_per_key, neighbour_in_time, rank_in_time, trailing_count


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 3000
    hot = rng.random(n) < 0.34
    data = [
        (None if i % 97 == 0 else "hot" if hot[i] else f"k{rng.integers(0, 40)}", int(rng.integers(-3600 * 5, 3600 * 90)) // 3 * 3, i, float(rng.integers(0, 9)))
        for i in range(n)
    ]
    df = spark.createDataFrame(data, "k string, s bigint, id bigint, v double")
    return df.withColumn("ts", F.timestamp_seconds("s")).cache()


def same(a, b, cols):
    assert sorted(map(tuple, a.select(*cols).collect()), key=repr) == sorted(map(tuple, b.select(*cols).collect()), key=repr)


def test_rank(rows):
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = rows.withColumn("rn", F.row_number().over(w).cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy("k")))
    same(rank_in_time(rows, ["k"], "ts", "id", 3600, total="n"), want, ["id", "rn", "n"])


@pytest.mark.parametrize("lead", [False, True])
def test_neighbour(rows, lead):
    w = Window.partitionBy("k").orderBy("ts", "id")
    fn = F.lead if lead else F.lag
    want = rows.withColumn("pv", fn("v").over(w)).withColumn("pt", fn("ts").over(w))
    got = neighbour_in_time(rows, ["k"], "ts", "id", {"pv": "v", "pt": "ts"}, 3600, lead=lead)
    same(got, want, ["id", "pv", "pt"])


@pytest.mark.parametrize("chunk", [900, 7200])
def test_trailing(rows, chunk):
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-900_000_000, 0)
    want = rows.withColumn("recent", F.count("*").over(w))
    same(trailing_count(rows, ["k"], "ts", 900, chunk), want, ["id", "recent"])


def test_trailing_needs_chunk_as_long_as_lookback(rows):
    with pytest.raises(ValueError):
        trailing_count(rows, ["k"], "ts", 900, 60)


def test_latest(rows):
    w = Window.partitionBy("k").orderBy(F.desc("ts"), F.desc("id"))
    want = rows.withColumn("r", F.row_number().over(w)).filter("r <= 3")
    same(latest_per_key(rows, ["k"], F.desc("ts"), F.desc("id"), n=3), want, ["id"])


@pytest.mark.parametrize("fraction", [0.0, 0.05, 0.5, 0.953, 1.0])
def test_percentile(rows, fraction):
    values = [r[0] for r in rows.select((F.col("v") * F.col("id") / 7).alias("x")).collect()]
    got = exact_percentile(rows.select((F.col("v") * F.col("id") / 7).alias("x")), "x", fraction)
    assert got == pytest.approx(float(np.percentile(values, fraction * 100)), rel=1e-9)


def test_percentile_cuts_a_heavy_bin_again(spark):
    """Two far outliers put all other rows into one bin; no aggregate may gather more than ``few`` rows."""
    values = [float(x) for x in range(5000)] + [-1e300, 1.7e308, 7.0, 7.0]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for fraction in (0.0, 0.31, 0.5, 0.9995, 1.0):
        assert exact_percentile(df, "x", fraction, bins=50, few=100) == pytest.approx(float(np.percentile(values, fraction * 100)), rel=1e-9)


@pytest.mark.parametrize("make", [lambda d: rank_in_time(d, ["k"], "ts", "id", total="n"), lambda d: neighbour_in_time(d, ["k"], "ts", "id", {"pv": "v"})])
def test_rows_are_shuffled_once(spark, rows, make, tmp_path):
    """With broadcast off the join and the window share one partitioning; the other exchanges carry aggregates."""
    rows.write.parquet(str(tmp_path / "rows"))
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        plan = make(spark.read.parquet(str(tmp_path / "rows")))._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    # what lies below each exchange, down to the next one or the end of its branch
    below = [part.split("FileScan")[0] for part in plan.split("Exchange hashpartitioning")[1:] if "FileScan" in part]
    assert sum("Aggregate" not in part for part in below) == 1, plan


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 20_000)), min_size=1, max_size=40))
def test_rank_property(spark, items):
    df = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(items)], "k string, s bigint, id bigint")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["rn"] for r in rank_in_time(df, ["k"], "ts", "id", 3600).collect()}
    for k in "ab":
        order = sorted((s, i) for i, (kk, s) in enumerate(items) if kk == k)
        for place, (_, i) in enumerate(order, 1):
            assert got[i] == place
