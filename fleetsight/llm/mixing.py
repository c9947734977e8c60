"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A document of source s is repeated N times, N Poisson with mean ``budget * weight_s / size_s``. N comes from inverting the
distribution at a number hashed from the document's id, so a rerun or a lost executor gives the same copies. Means above
``UNIT`` are sums of equal parts with a hash each, so no table of probabilities grows with the mean. Copies are then
dealt to random places: partitions by a hash of document and copy, and in its order within each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.stage import shuffle_partitions, written

#: Largest mean that is inverted at once.
UNIT = 8.0
#: Terms of the distribution; beyond them the probability is below 2**-52 for means up to UNIT.
TERMS = 48
#: Sources up to which their rates (under 1 kB each) are broadcast.
BROADCAST_SOURCES = 10_000


def uniform(*parts: F.Column) -> F.Column:
    """A number in [0, 1) from the MD5 of the parts joined by colons (52 bits)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def thresholds(mean: F.Column) -> F.Column:
    """Cumulative probabilities of 0, 1, 2, ... for a mean up to UNIT."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def add(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda acc: acc["c"])


def rates(docs: DataFrame, source_col: str = "source", weights: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """(source, size, rate, parts, cdf) per source, null being a source of its own.

    ``weights(source, weight)`` are target shares, normalised over the sources present; none gives all sources the same.
    A source without a weight, or with one that is null or not positive, gets no copies. ``budget`` is the expected number
    of rows of the result, the size of ``docs`` unless given.
    """
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("size"))
    if weights is None:
        wanted = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("__wanted")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        wanted = sizes.join(given, F.col("__source").eqNullSafe(F.col("__wanted")), "left").drop("__wanted").fillna(0.0, ["weight"])
    total = wanted.agg(F.sum("weight").alias("w"), F.sum("size").alias("n"))
    rate = F.coalesce(F.col("weight") / F.nullif(F.col("w"), F.lit(0.0)) * (F.lit(budget) if budget is not None else F.col("n")) / F.col("size"), F.lit(0.0))
    found = wanted.join(F.broadcast(total)).withColumn("rate", rate)  # total is one row
    found = found.withColumn("parts", F.greatest(F.ceil(F.col("rate") / UNIT), F.lit(1)).cast("int"))
    return found.select("__source", "size", "rate", "parts", thresholds(F.col("rate") / F.col("parts")).alias("cdf"))


def copies(key: F.Column, seed: int, rate: F.Column) -> F.Column:
    """How often a document is repeated whose source has the rate row ``rate``."""

    def part(total, j):
        u = uniform(key, j, F.lit(seed))
        return total + F.size(F.filter(rate["cdf"], lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(1), rate["parts"]), F.lit(0), part)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: DataFrame | None = None, budget: float | None = None, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` for every copy, ``copy`` (from 1) and ``place``, the random number that orders the result.

    Partitions are random and each is sorted by ``place``, so reading them in turn reads a shuffled corpus. Rows with a
    null id hash as the empty string; rows that repeat an id are repeated alike. Null texts are copied like others. An
    empty table gives an empty result. Columns of ``docs`` named copy or place are replaced.
    """
    spark = docs.sparkSession
    # one small row per source: broadcast after a look at their number, else joined with the hot source split by AQE
    found = written(rates(docs, source_col, weights, budget), "mixing-rates")
    few = found.count() <= BROADCAST_SOURCES
    found = found.select("__source", F.struct("parts", "cdf").alias("__rate"))  # names of its own: docs may have any columns
    found = F.broadcast(found) if few else found
    mine = docs.drop("copy", "place").join(found, F.col(source_col).eqNullSafe(F.col("__source")))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    counted = mine.withColumn("__n", copies(key, seed, F.col("__rate"))).where("__n > 0")
    dealt = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "__source", "__rate")
    dealt = dealt.withColumn("place", uniform(key, F.col("copy"), F.lit(seed), F.lit("place")))
    return dealt.repartition(shuffle_partitions(spark), "place").sortWithinPartitions("place")


#: The rows of ``mix`` over ``documents`` with equal weights (without its order), in the oracle's dialect.
ORACLE = """
WITH sizes AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
total AS (SELECT count(*) AS k, sum(size) AS n FROM sizes),
rates AS (SELECT source, 1.0::DOUBLE / k::DOUBLE * n::DOUBLE / size::DOUBLE AS rate FROM sizes, total),
split AS (SELECT source, rate, greatest(ceil(rate / 8.0), 1)::INT AS parts FROM rates),
steps AS (SELECT source, parts, rate / parts AS mean, t.k AS k FROM split, range(0, 49) t(k)),
probabilities AS (SELECT source, parts, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM steps),
cdfs AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM probabilities),
lists AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cdf FROM cdfs GROUP BY source),
draws AS (SELECT d.doc_id, d.source, cdf,
   ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || j.j || ':17'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
 FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source, range(1, 100000) j(j) WHERE j.j <= l.parts),
counts AS (SELECT doc_id, sum(len(list_filter(cdf, lambda c: c <= u)))::BIGINT AS n FROM draws GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.c::INT AS copy,
 ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || c.c || ':17:place'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS place
FROM documents d JOIN counts ON d.doc_id IS NOT DISTINCT FROM counts.doc_id, range(1, 100000) c(c) WHERE c.c <= n
"""
