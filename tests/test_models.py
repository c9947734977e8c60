"""Isolation forest and k-means on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsight.operators import scoring

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 3))
    x[:20] += 9
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "rid bigint, a double, b double, c double")


def test_outliers_rank_first(planted):
    rows = scoring.isolation_forest(planted, "rid", COLS, contamination=0.05).collect()
    score = {r["rid"]: r["anomaly_score"] for r in rows}
    top = sorted(score, key=score.get, reverse=True)[:20]
    assert len(set(top) & set(range(20))) >= 18
    assert sum(r["is_anomaly"] for r in rows) == 50
    assert min(score.values()) == 0.0 and max(score.values()) == 1.0


def test_scores_do_not_depend_on_partitioning(planted):
    one = {r["rid"]: r["anomaly_score"] for r in scoring.isolation_forest(planted.coalesce(1), "rid", COLS, trees=20).collect()}
    many = {r["rid"]: r["anomaly_score"] for r in scoring.isolation_forest(planted.repartition(7), "rid", COLS, trees=20).collect()}
    assert one == pytest.approx(many, rel=1e-6)


def test_constant_features_give_equal_scores(spark):
    df = spark.range(30).select(F.col("id").alias("rid"), *[F.lit(1.0).alias(c) for c in COLS])
    rows = scoring.isolation_forest(df, "rid", COLS, trees=5).collect()
    assert {r["anomaly_score"] for r in rows} == {0.0} and not any(r["is_anomaly"] for r in rows)


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(1)
    data = [(i, *(float(v) for v in rng.normal(size=3) * 0.1 + 5 * (i % 3))) for i in range(90)]
    rows = scoring.kmeans_clusters(spark.createDataFrame(data, "rid bigint, a double, b double, c double"), COLS).collect()
    groups = {k: {r["cluster_id"] for r in rows if r["rid"] % 3 == k} for k in range(3)}
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 3


def test_single_row_has_no_cluster(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "rid bigint, a double, b double, c double")
    assert scoring.kmeans_clusters(df, COLS).first()["cluster_id"] is None


def test_small_batch_uses_the_heuristic(spark, tables):
    few = tables.snaps().limit(5)
    rows = scoring.scoring_cycle(few, F.current_timestamp()).collect()
    assert all(r["cluster_id"] is None for r in rows)
    assert {r["model_version"] for r in rows} == {"v2-isof"}
