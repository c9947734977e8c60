"""Anomaly and failure scoring: heuristic, isolation forest, k-means."""

from __future__ import annotations

import json
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.coerce import clamp
from fleetsight.functions.ordered import exact_percentile, latest_per_key
from fleetsight.operators.features import training_batch
from fleetsight.schemas import (
    FEATURES,
    FOREST_CONTAMINATION,
    FOREST_TREES,
    KMEANS_CLUSTERS,
    KMEANS_RUNS,
    ML_MIN_ROWS,
    MODEL_SEED,
    MODEL_VERSION,
    SCORE,
)

SAMPLE_SIZE = 256  # rows per tree, as in the isolation-forest paper (Liu et al. 2008)
CANDIDATES = 2  # times the rows of a tree that its hash rule lets through on average


def _double(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


# ---------------------------------------------------------------- heuristic


def heuristic_score() -> Column:
    cpu = F.when(_double("cpu_usage_percent") > 85, 0.3).otherwise(0.0)
    memory = F.when(_double("memory_usage_percent") > 90, 0.3).otherwise(0.0)
    critical = F.when(_double("critical_count") > 2, 0.4).otherwise(0.0)
    return F.least(cpu + memory + critical, F.lit(1.0))


def heuristic_fault() -> Column:
    return (
        F.when(_double("critical_count") > 3, "SYSTEM_FAILURE")
        .when(_double("error_count") > 5, "SERVICE_DEGRADATION")
        .otherwise("NONE")
    )


def failure_probability() -> Column:
    return F.least(_double("critical_count") * 0.2 + _double("error_count") * 0.1, F.lit(1.0))


def heuristic_scores(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumns(
        {
            "anomaly_score": heuristic_score(),
            "failure_probability": failure_probability(),
            "predicted_fault": heuristic_fault(),
        }
    ).withColumn("is_anomaly", F.col("anomaly_score") >= 0.5)


def prediction_rows(scored: DataFrame, time_column: str = "snapshot_time") -> DataFrame:
    """Rows as they are appended: scores clamped to [0, 1] at three decimals, fault defaults to NONE."""
    cluster = F.col("cluster_id").cast("int") if "cluster_id" in scored.columns else F.lit(None).cast("int")
    return scored.select(
        "system_id",
        F.col(time_column).alias("prediction_time"),
        clamp(F.col("anomaly_score"), 0.0, 1.0).cast(SCORE).alias("anomaly_score"),
        "is_anomaly",
        clamp(F.col("failure_probability"), 0.0, 1.0).cast(SCORE).alias("failure_probability"),
        F.coalesce(F.nullif("predicted_fault", F.lit("")), F.lit("NONE")).alias("predicted_fault"),
        cluster.alias("cluster_id"),
        F.lit(MODEL_VERSION).alias("model_version"),
    )


def heuristic_predictions(snapshots: DataFrame) -> DataFrame:
    return prediction_rows(heuristic_scores(snapshots))


# ---------------------------------------------------------------- features


def standardize(rows: DataFrame, columns: list[str] = FEATURES, prefix: str = "z_") -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0.

    The moments are one global aggregate (one row on the driver, used as literals), so no join is needed.
    """
    moments = rows.agg(
        *[F.avg(_double(c)).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(_double(c)).alias(f"s_{c}") for c in columns],
    ).first()
    out = {}
    for c in columns:
        mean, spread = moments[f"m_{c}"], moments[f"s_{c}"]
        out[f"{prefix}{c}"] = (_double(c) - F.lit(mean or 0.0)) / F.lit(spread or 1.0)
    return rows.withColumns(out)


# ---------------------------------------------------------------- isolation forest


def _path_norm(n) -> np.ndarray:
    """Average path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    """One tree over a bounded sample, as flat arrays. Leaves have feature -1 and hold their path length."""
    feature, threshold, left, right, length = [], [], [], [], []
    pending = [(np.arange(len(x)), 0, -1, False)]
    while pending:
        rows, depth, parent, is_right = pending.pop()
        me = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        for column in (feature, left, right):
            column.append(-1)
        threshold.append(0.0)
        length.append(0.0)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            length[me] = depth + float(_path_norm([len(rows)])[0])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        feature[me], threshold[me] = f, cut
        goes_left = x[rows, f] <= cut
        pending.append((rows[~goes_left], depth + 1, me, True))
        pending.append((rows[goes_left], depth + 1, me, False))
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "length": length}


def fit_forest(
    rows: DataFrame, row_id: str, columns: list[str], trees: int = FOREST_TREES, seed: int = MODEL_SEED
) -> tuple[list[dict], int]:
    """Grow the trees in Spark, one task group per tree; only the finished trees (about 500 nodes each) come back.

    A row is a candidate of a tree if a hash of (row id, tree, seed) falls below one threshold for all rows and trees, so
    the sample depends on neither partitioning nor size. The smallest hashes of a tree's candidates are its sample.
    """
    n = rows.count()
    size = min(SAMPLE_SIZE, n)
    share = min(1.0, CANDIDATES * size / max(n, 1))
    mark = lambda tree: F.xxhash64("rid", tree, F.lit(seed))
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: F.pmod(mark(tree), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
    spread = rows.select(F.col(row_id).alias("rid"), *columns).withColumn("tree", F.explode(mine)).withColumn("h", mark(F.col("tree")))
    # A fixed number of partitions: AQE would merge these small groups and grow every tree in one task.
    spread = spread.repartition(min(trees, max(8, rows.sparkSession.sparkContext.defaultParallelism)), "tree")
    sample = latest_per_key(spread, ["tree"], F.col("h"), F.col("rid"), n=size)
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        x = group.sort_values(["h", "rid"])[columns].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        return pd.DataFrame({"tree": [tree], "nodes": [json.dumps(_grow(x, rng, limit))]})

    grown = sample.groupBy("tree").applyInPandas(grow, "tree int, nodes string").orderBy("tree").collect()
    return [json.loads(r["nodes"]) for r in grown], size


def forest_scores(rows: DataFrame, forest: list[dict], size: int, columns: list[str], out: str = "iso") -> DataFrame:
    """Isolation score ``2^(-E[path] / c(size))`` per row; higher means easier to isolate."""
    compact = [{k: np.asarray(v) for k, v in t.items()} for t in forest]
    norm = float(_path_norm([size])[0]) or 1.0

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        x = np.column_stack([f.to_numpy(dtype=float) for f in features])
        total = np.zeros(len(x))
        index = np.arange(len(x))
        for t in compact:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = t["feature"][node]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[index[inner], f[inner]] <= t["threshold"][node[inner]]
                node[inner] = np.where(go_left, t["left"][node[inner]], t["right"][node[inner]])
            total += t["length"][node]
        return pd.Series(np.power(2.0, -(total / len(compact)) / norm))

    return rows.withColumn(out, score(*[F.col(c).cast("double") for c in columns]))


def isolation_forest(
    snapshots: DataFrame,
    row_id: str,
    columns: list[str] = FEATURES,
    trees: int = FOREST_TREES,
    contamination: float = FOREST_CONTAMINATION,
    seed: int = MODEL_SEED,
) -> DataFrame:
    """Adds ``anomaly_score`` in [0, 1] (1 = most anomalous) and ``is_anomaly`` (beyond the contamination cut)."""
    rows = snapshots.persist()  # read by the moments, the sample and the scoring pass
    scaled = standardize(rows, columns)
    z = [f"z_{c}" for c in columns]
    forest, size = fit_forest(scaled, row_id, z, trees, seed)
    scored = forest_scores(scaled, forest, size, z).persist()
    low, high = scored.agg(F.min("iso"), F.max("iso")).first()
    cut = exact_percentile(scored, "iso", 1.0 - contamination)
    span = (high - low) if high is not None and high != low else 1.0
    return scored.withColumn("anomaly_score", (F.col("iso") - F.lit(low)) / F.lit(span)).withColumn(
        "is_anomaly", F.col("iso") > F.lit(cut)
    ).drop("iso", *z)


# ---------------------------------------------------------------- k-means


def kmeans_clusters(
    rows: DataFrame, columns: list[str] = FEATURES, k: int = KMEANS_CLUSTERS, runs: int = KMEANS_RUNS, seed: int = MODEL_SEED
) -> DataFrame:
    """Adds ``cluster_id`` from the best of ``runs`` seeded k-means fits (k is at most the number of rows)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    scaled = standardize(rows, columns)
    z = [f"z_{c}" for c in columns]
    vectors = VectorAssembler(inputCols=z, outputCol="__features").transform(scaled).persist()
    k = min(k, vectors.limit(k).count())
    if k < 2:
        return rows.withColumn("cluster_id", F.lit(None).cast("int"))

    def fit(attempt: int):
        model = KMeans(k=k, seed=seed + attempt, featuresCol="__features", predictionCol="cluster_id").fit(vectors)
        return model.summary.trainingCost, attempt, model

    # The runs are independent sequences of small jobs; a few driver threads keep the cluster busy with them.
    with ThreadPool(min(runs, 5)) as pool:
        fitted = pool.map(fit, range(runs))
    best = min(fitted, key=lambda f: f[:2])
    return best[2].transform(vectors).drop("__features", *z)


# ---------------------------------------------------------------- cycle


def latest_snapshot_per_host(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per host; a missing host id counts as ``unknown``, ties go to the higher id if there is one."""
    order = [F.col("snapshot_time").desc_nulls_last()]
    if "id" in snapshots.columns:
        order.append(F.col("id").desc())
    named = snapshots.withColumn("system_id", F.coalesce(F.nullif("system_id", F.lit("")), F.lit("unknown")))
    return latest_per_key(named, ["system_id"], *order)


def scoring_cycle(
    snapshots: DataFrame, as_of: Column, batch_rows: int | None = None, min_rows: int = ML_MIN_ROWS, use_model: bool = True
) -> DataFrame:
    """Score all snapshots, or the newest ``batch_rows``, and keep one prediction per host.

    With at least ``min_rows`` snapshots the forest and k-means decide, otherwise the heuristic (whose rows have
    no cluster).
    """
    batch = training_batch(snapshots, batch_rows) if batch_rows else snapshots
    enough = use_model and batch.limit(min_rows).count() >= min_rows
    if enough:
        keyed = batch.withColumn("__rid", F.xxhash64("system_id", "snapshot_time"))
        scored = kmeans_clusters(isolation_forest(keyed, "__rid"))
        fault = (
            F.when(F.col("is_anomaly") & (_double("critical_count") > 3), "SYSTEM_FAILURE")
            .when(F.col("is_anomaly"), "SERVICE_DEGRADATION")
            .otherwise("NONE")
        )
        scored = scored.withColumn("predicted_fault", fault).withColumn("failure_probability", failure_probability())
    else:
        scored = heuristic_scores(batch)
    newest = latest_snapshot_per_host(scored).withColumn("__now", as_of)
    return prediction_rows(newest, "__now")
