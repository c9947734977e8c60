"""Connected components of an edge table by repeated smallest-neighbour steps with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.stage import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(cid, comp) for every node of ``edges(src, dst)``: ``comp`` is the smallest node reachable.

    Large-star and small-star steps, each one shuffle with map-side minima, until no edge changes. Edges are replaced
    by ever fewer hops to the smallest neighbour, so the number of rounds is logarithmic in the longest path and a hot
    node never has its neighbours gathered: only its minimum is.
    """
    now = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    mark = _mark(now)
    while True:
        # large star: every neighbour above a node moves to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        small_low = large.groupBy("src").agg(F.min("dst").alias("m"))
        moved = large.join(small_low, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        after = written(moved.where("src <> dst").distinct(), "cc")
        mark, before = _mark(after), mark
        forget(now)
        now = after
        if mark == before:
            break
    nodes = now.select(F.col("src").alias("cid"), F.col("dst").alias("comp"))
    return nodes.unionByName(now.select(F.col("dst").alias("cid"), F.col("dst").alias("comp"))).groupBy("cid").agg(F.min("comp").alias("comp"))


def _mark(edges: DataFrame) -> tuple:
    """Count and two sums over hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.sum(F.hash("dst", "src").cast("long"))).first())
