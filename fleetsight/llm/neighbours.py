"""Approximate nearest neighbours: a forest of random-projection trees and a queue shared by all trees of a query.

Trees split a bounded sample of the vectors at the median of a projection on the line between two of them; every vector is
then routed to its leaf of each tree. A query opens leaves in the order of their distance to the splits passed, over all
trees at once, and its candidates are ranked by exact distance leaf by leaf.

A vector is not sent to its leaves: it stays in one shard of the table, and every shard gets all queries. A query takes
along how far its queue went, not the leaves that this opens, and walks down the trees again over the vectors of a shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from fleetsight.llm.stage import shuffle_partitions, written

TREES = 16
#: Vectors that the trees are grown on, at most: those with the smallest hashes.
SAMPLE_ROWS = 20_000
#: Rows wanted in a leaf; a tree has no more leaves than a quarter of its sample.
LEAF_ROWS = 150
#: Leaves that a query opens over all trees, at least.
LEAVES = 320
#: Share of all leaves that a query opens, so that the share of rows it sees does not fall as the table grows.
LEAF_SHARE = 0.04
#: Bytes of vectors that a task holds at once.
SHARD_BYTES = 100_000_000
#: Tasks wanted at least: the trees of a small table go to several tasks, each with all vectors of a shard.
TASKS = 4


@dataclass
class Tree:
    sample: np.ndarray  # shared by all trees
    ends: np.ndarray  # (inner nodes, 2): the rows of the sample that a split lies between
    size: np.ndarray  # their distance
    cut: np.ndarray
    child: np.ndarray  # (inner nodes, 2): an inner node, or ~leaf
    turn: np.ndarray  # the order in which inner nodes were made; they are numbered level by level

    def __reduce__(self):
        # without what follows from the fields, which is several times as large
        return Tree, (self.sample, self.ends, self.size, self.cut, self.child, self.turn)

    @cached_property
    def normal(self) -> np.ndarray:
        """(inner nodes, dimension)"""
        a, b = self.ends.T
        return (self.sample[a] - self.sample[b]) / self.size[:, None]

    @cached_property
    def above(self) -> np.ndarray:
        """The node above each node and leaf, by the numbers in ``child``; -1 above the root."""
        out = np.full(2 * len(self.cut) + 1, -1)
        out[self.child[:, 0]] = out[self.child[:, 1]] = np.arange(len(self.cut))
        return out

    @cached_property
    def levels(self) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of each level its first inner node and the one behind it, and where among their children, two by two, inner nodes
        and leaves are."""
        out, at, end = [], 0, min(1, len(self.cut))
        while at < end:
            below = self.child[at:end].ravel()
            out.append((at, end, np.flatnonzero(below >= 0), np.flatnonzero(below < 0)))
            at, end = end, end + len(out[-1][2])
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers of rows of vectors."""
        if len(self.cut) == 0:
            return np.zeros(len(x), np.int32)
        if len(x) > SLICE:
            return np.concatenate([self.leaves(x[at : at + SLICE]) for at in range(0, len(x), SLICE)])
        x, node = x.astype(np.float64, copy=False), np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            at = node[live]
            side = np.einsum("ij,ij->i", x[live], self.normal[at]) > self.cut[at]
            node[live] = self.child[at, side.astype(int)]
            live = live[node[live] >= 0]
        return (~node).astype(np.int32)

    @cached_property
    def lined(self) -> np.ndarray:
        """The leaves, level by level."""
        return ~self.child[self.child < 0] if len(self.cut) else np.zeros(1, np.int64)

    def spread(self, q: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Fill in, by query and leaf (those of a level after those of the levels above), the largest distance to the splits
        above that the query lies on the other side of; gives the signed distances to all splits, by query and inner node."""
        margins, above, at = q @ self.normal.T - self.cut, np.zeros((len(q), 1)), 0
        far[:, 0] = 0  # of a tree without splits
        for a, b, inner, outer in self.levels:
            below = np.empty((len(q), b - a, 2))
            np.fmax(above, margins[:, a:b], out=below[:, :, 0])
            np.fmax(above, -margins[:, a:b], out=below[:, :, 1])
            below = below.reshape(len(q), -1)
            far[:, at : at + len(outer)] = below[:, outer] if len(inner) else below
            above, at = below[:, inner] if len(outer) else below, at + len(outer)
        return margins


def grown(sample: np.ndarray, least: int, rng: np.random.Generator) -> Tree:
    ends, size, cut, child, leaves = [], [], [], [], 0
    todo = [(np.arange(len(sample)), None)]
    while todo:
        rows, parent = todo.pop()
        split = None
        if len(rows) > least:
            for _ in range(5):
                pair = rng.choice(rows, 2, replace=False)
                a, b = sample[pair]
                along = sample[rows] @ (a - b)
                halves = [(len(rows) - 1) // 2, len(rows) // 2]
                middle = np.partition(along, halves)[halves].sum() / 2
                if 0 < (along > middle).sum() < len(rows):
                    split = (pair, np.linalg.norm(a - b), middle, along > middle)
                    break
        if split is None:
            name, leaves = ~leaves, leaves + 1
        else:
            name = len(cut)
            ends.append(split[0])
            size.append(split[1])
            cut.append(split[2] / split[1])
            child.append([0, 0])
            todo += [(rows[~split[3]], (name, 0)), (rows[split[3]], (name, 1))]
        if parent:
            child[parent[0]][parent[1]] = name
    child = np.array(child, np.int64).reshape(-1, 2)
    turn, level = [], np.arange(min(1, len(cut)))
    while len(level):
        turn.append(level)
        level = child[level].ravel()
        level = level[level >= 0]
    turn = np.concatenate([np.zeros(0, np.int64), *turn])
    child = np.where(child < 0, child, np.argsort(turn)[np.maximum(child, 0)])[turn] if len(cut) else child
    return Tree(sample, np.array(ends, np.int64).reshape(-1, 2)[turn], np.array(size)[turn], np.array(cut)[turn], child, turn)


def in_turn(forest: list[Tree], margins: list[np.ndarray], last: float, tied: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The first ``most`` (tree, leaf) of those just as far as ``last``, in the order in which the queue gives them."""
    entries = set()
    for t, leaf in tied:
        node = top = ~leaf
        while (up := int(forest[t].above[node])) >= 0:
            margin = margins[t][up]
            if last == 0:
                top = up
            elif abs(margin) == last and node != forest[t].child[up, int(margin > 0)]:
                top = node
            node = up
        entries.add((t, top))
    turn = lambda t, node: (t, int(forest[t].turn[node]) if node >= 0 else node, node)
    queue = sorted(turn(t, node) for t, node in entries)
    out = []
    while len(out) < most:
        t, _, node = heapq.heappop(queue)
        while node >= 0:
            margin = margins[t][node]
            side = int(margin > 0)
            if not abs(margin) > last:
                heapq.heappush(queue, turn(t, int(forest[t].child[node, 1 - side])))
            node = int(forest[t].child[node, side])
        out.append((t, ~node))
    return out


def reached(forest: list[Tree], q: np.ndarray, leaves: int) -> list[tuple[float, float, list[int]]]:
    """(under, beyond, tied) of each query: the queue of all trees gives the branch least far beyond its splits, until
    ``leaves`` are open. These are all leaves nearer than ``under`` and the listed ones, numbered over all trees; no leaf as
    far as ``beyond`` is among them. Both lie between distances that occur, so rounding does not matter; both are NaN where
    all leaves are open."""
    first = np.cumsum([0] + [len(tree.cut) + 1 for tree in forest])
    if leaves >= first[-1]:
        return [(math.nan, math.nan, [])] * len(q)
    every = np.empty((len(q), first[-1]))
    margins = [tree.spread(q, every[:, a:b]) for tree, a, b in zip(forest, first, first[1:])]
    out = []
    for j, far in enumerate(every):
        last = np.partition(far, leaves - 1)[leaves - 1]
        near, after = far[far < last], far[far > last]
        beyond = (last + after.min()) / 2 if len(after) else math.nan
        same = np.flatnonzero(far == last)
        if len(near) + len(same) == leaves:
            out.append((beyond, beyond, []))
            continue
        trees = np.searchsorted(first, same, "right") - 1
        tied = in_turn(forest, [m[j] for m in margins], last, [(int(t), int(forest[t].lined[i - first[t]])) for t, i in zip(trees, same)], leaves - len(near))
        out.append(((near.max() + last) / 2 if len(near) else 0.0, beyond, [int(first[t]) + leaf for t, leaf in tied]))
    return out


#: Queries of which the distances to all splits are held at once, and vectors routed, or compared with queries, at a time.
SPREAD, SLICE = 32, 10_000
#: Bytes of queries, as doubles, that walk down the trees together.
BLOCK_BYTES = 10_000_000
#: Distances compared at a time, and ids that wait for the exact ranking, about.
TILE, WAITING = 200_000, 100_000
ASKED_DDL = "query long, under double, beyond double, tied array<int>"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _routed_queries(forest: list[Tree], leaves: int):
    """(vector, id) of queries to what they take along: how far their queue goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SPREAD):
                part = batch.slice(at, SPREAD)
                under, beyond, tied = zip(*reached(forest, _matrix(part.column(0)).astype(np.float64), leaves))
                made = {"v": part.column(0).cast(pa.list_(part.column(0).type.value_type)), "query": part.column(1).cast(pa.int64())}
                made |= {"under": pa.array(under, pa.float64()), "beyond": pa.array(beyond, pa.float64()), "tied": pa.array(tied, pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_pydict(made)

    return run


def squared(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x.astype(np.float64) ** 2).sum(axis=1)


def plain(squares: np.ndarray) -> bool:
    """Whether products of such vectors are exact as floats but for rounding."""
    return bool(squares.min() > 1e-12 and squares.max() < 1e12)


class Shard:
    """Vectors with their ids, by leaf of each tree."""

    def __init__(self, forest: list[Tree], trees: range, v: list[np.ndarray], counts: np.ndarray, ids: np.ndarray):
        n, d = sum(map(len, v)), v[0].shape[1]
        self.trees = [forest[t] for t in trees]
        first = np.cumsum([0] + [len(tree.cut) + 1 for tree in forest])
        self.first, self.leaves = [int(first[t]) for t in trees], int(first[-1])
        squares = np.concatenate([squared(part[at : at + SLICE]) for part in v for at in range(0, len(part), SLICE)])
        # floats stay floats where products of them neither overflow nor vanish
        kind = np.float32 if v[0].dtype == np.float32 and plain(squares) else np.float64
        #: Rounding of a product, of the lengths that meet in it.
        self.rounding = 2e-5 if kind == np.float32 else 1e-9
        # with their squared lengths and a one: the product with a query then is the squared distance less the query's limit
        self.x = np.ones((n, d + 2), kind)
        self.x[:, d] = squares
        at = 0
        while v:
            part = v.pop(0)
            self.x[at : at + len(part), :d] = part
            at += len(part)
        self.counts, self.ids, self.starts = counts, ids, np.cumsum(counts) - counts
        self.tile, self.waiting = int(TILE / counts.mean()), int(WAITING / counts.mean())
        self.by_leaf = []
        for tree in self.trees:
            leaf = tree.leaves(self.x[:, :d])
            self.by_leaf.append((np.argsort(leaf, kind="stable").astype(np.int32), np.searchsorted(np.sort(leaf), np.arange(len(tree.cut) + 2))))

    def rows(self, tree: int, leaf: int) -> np.ndarray:
        order, begin = self.by_leaf[tree]
        return order[begin[leaf] : begin[leaf + 1]]


class Asked:
    """Queries that walk down the trees over one shard, and the nearest ids that each has met so far."""

    def __init__(self, shard: Shard, k: int, v: np.ndarray, own: np.ndarray, under: np.ndarray, beyond: np.ndarray, tied: pa.Array):
        self.shard, self.k, self.d, self.own, self.under, self.beyond = shard, k, v.shape[1], own, under, beyond
        self.v = v
        self.squares = squared(v)
        self.signed = np.concatenate([-2 * v, np.ones((len(v), 1)), np.full((len(v), 1), -np.inf)], axis=1)
        if plain(self.squares):
            self.signed = self.signed.astype(shard.x.dtype)
        self.limit = np.full(len(v), np.inf)
        by = np.repeat(np.arange(len(v)), tied.value_lengths().to_numpy(zero_copy_only=False))
        leaf = tied.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(leaf, kind="stable")
        self.tied_from, self.tied_query = np.searchsorted(leaf[order], np.arange(shard.leaves + 1, dtype=np.int32)), by[order]
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def compare(self, rows: np.ndarray, queries: np.ndarray) -> None:
        """Keep the pairs whose distance, but for rounding, is within the query's limit."""
        for a in range(0, len(rows), SLICE):
            some = rows[a : a + SLICE]
            x = self.shard.x.take(some, axis=0)
            slack = self.shard.rounding * x[:, self.d].max()
            wide = max(1, self.shard.tile // len(some))
            for b in range(0, len(queries), wide):
                asking = queries[b : b + wide]
                i, j = np.divmod(np.flatnonzero(~(self.signed.take(asking, axis=0) @ x.T > slack)), len(some))  # a NaN is kept
                self.waiting.append((asking[i], some[j]))
                self.held += len(i)
                if self.held > self.shard.waiting:
                    self.rank()

    def rank(self) -> None:
        """The exact distances of what waits; of all ids met by a query the ``k`` nearest stay."""
        query, row = (np.concatenate(x) for x in zip(*self.waiting)) if self.waiting else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.waiting, self.held = [], 0
        far = np.empty(len(query))
        for a in range(0, len(query), SLICE):
            far[a : a + SLICE] = np.sqrt(((self.shard.x[row[a : a + SLICE], : self.d] - self.v[query[a : a + SLICE]]) ** 2).sum(axis=1))
        near = far <= self.limit[query]
        query, row, far = query[near], row[near], far[near]
        counts = self.shard.counts[row]
        of = np.repeat(np.arange(len(row)), counts)
        ids = self.shard.ids[self.shard.starts[row][of] + np.arange(len(of)) - (np.cumsum(counts) - counts)[of]]
        other = ids != self.own[query[of]]
        query, far, ids = (np.concatenate(x) for x in zip(self.best, (query[of][other], far[of][other], ids[other])))
        order = np.lexsort((ids, far, query))
        query, far, ids = query[order], far[order], ids[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (far[1:] != far[:-1]) | (ids[1:] != ids[:-1])
        query, far, ids = query[new], far[new], ids[new]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.k - 1
        self.limit[query[full]] = far[full]
        self.signed[:, -1] = self.squares * (1 - self.shard.rounding) - self.limit**2 * (1 + self.shard.rounding)
        self.best = query[place < self.k], far[place < self.k], ids[place < self.k]

    def walk(self, t: int) -> None:
        """Down one tree, all queries together: each goes where its queue went."""
        tree, first = self.shard.trees[t], self.shard.first[t]
        child = tree.child.tolist()
        todo = [(0 if len(tree.cut) else -1, np.arange(len(self.v)), np.zeros(len(self.v)))]
        while todo:
            node, queries, far = todo.pop()
            if node < 0:
                a, b = self.tied_from[first + ~node], self.tied_from[first + ~node + 1]
                rows = self.shard.rows(t, ~node)
                if len(rows):
                    self.compare(rows, np.concatenate([queries[~(far >= self.under[queries])], self.tied_query[a:b]]))
                continue
            margin = self.v.take(queries, axis=0) @ tree.normal[node] - tree.cut[node]
            beyond = self.beyond[queries]
            for below, on in zip(child[node], (np.fmax(far, margin), np.fmax(far, -margin))):
                go = np.flatnonzero(~(on >= beyond))
                if len(go):
                    todo.append((below, queries.take(go), on.take(go)))

    @np.errstate(over="ignore", invalid="ignore")
    def found(self) -> pa.RecordBatch:
        # their own leaves first, as near rows there keep the others out early
        for t, tree in enumerate(self.shard.trees):
            home = np.where(self.under <= 0, -1, tree.leaves(self.v))
            order = np.argsort(home, kind="stable")
            for queries in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                if home[queries[0]] >= 0:
                    self.compare(self.shard.rows(t, home[queries[0]]), queries)
        self.rank()
        for t in range(len(self.shard.trees)):
            self.walk(t)
        self.rank()
        query, far, ids = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.own[query]), pa.array(ids), pa.array(far)], schema=FOUND)


def _ranked(forest: list[Tree], groups: int, k: int):
    """Rows of one part after another, its vectors first, to each query's nearest rows of the shard by the part's trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, rows, asking = None, None, [], []

        def gathered() -> Shard:
            counts, ids = (np.concatenate([row[c] for row in rows]) for c in (1, 2))
            v = [row[0] for row in rows]
            rows.clear()  # so that vectors go as they are put into place
            return Shard(forest, range(now % groups, len(forest), groups), v, counts, ids)

        def answer() -> pa.RecordBatch:
            v, own, under, beyond, tied = (pa.chunked_array(c).combine_chunks() for c in zip(*asking))
            asking.clear()
            return Asked(shard, k, _matrix(v).astype(np.float64), *(c.to_numpy() for c in (own, under, beyond)), tied).found()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            part, own = batch.column("part").to_numpy(), batch.column("query")
            kind = own.is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(part, prepend=part[:1] - 1) | np.diff(kind, prepend=False))
            for a, b in zip(starts, [*starts[1:], len(part)]):
                some = batch.slice(a, b - a)
                if part[a] != now:
                    if asking:
                        yield answer()
                    now, shard = part[a], None
                    rows.clear()
                if not kind[a]:
                    ids = some.column("ids")
                    rows.append((_matrix(some.column("v")), ids.value_lengths().to_numpy(), ids.flatten().to_numpy()))
                    continue
                if rows:
                    shard = gathered()
                if shard is None:  # no vector in this shard
                    continue
                wide = max(1, BLOCK_BYTES // (8 * shard.x.shape[1]))
                for at in range(0, some.num_rows, wide):
                    asking.append([some.slice(at, wide).column(c) for c in ("v", "query", "under", "beyond", "tied")])
                    if sum(len(x[0]) for x in asking) >= wide:
                        yield answer()
        if asking:
            yield answer()

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite numbers, not all zero, of the most frequent dimension. Floats stay
    floats, which take half the room."""
    v = F.col("v")
    given = vectors.select(vector_col).schema[0].dataType
    kind = "array<float>" if getattr(given, "elementType", None) == FloatType() else "array<double>"
    fine = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    common = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "d").first()
    return fine.where(F.size("v") == (common["d"] if common else 0))


def smallest(distinct: DataFrame, n: int, most: int, seed: int) -> np.ndarray:
    """The ``most`` vectors with the smallest hashes. Of a large table only twice as many are sorted, which a bound on the
    hash gives; should they be too few, all are."""
    hashed = distinct.select("v", F.xxhash64(F.col("v").cast("array<double>"), F.lit(seed)).alias("h"))
    for bound in (2 * most / max(n, 1), 1):
        some = hashed.where(F.col("h") < int(bound * 2**64) - 2**63) if bound < 1 else hashed
        found = some.orderBy("h").limit(most).collect()
        if bound >= 1 or len(found) == most:
            return np.array([r["v"] for r in found])


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaves: int = LEAVES, leaf_share: float = LEAF_SHARE, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query, its own id left out.

    ``is_query`` is a condition on ``vec_id``. Distances are Euclidean, in double precision, ties go to the smaller id.
    Equal vectors are one entry of the index with their ``k + 1`` smallest ids, so a vector that a third of the rows share
    fills no leaf. Null, zero or non-finite vectors, null ids and vectors of a rarer dimension take no part. Repeated rows
    (same id and vector) count once; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    fine = usable(vectors, id_col, vector_col)
    # repeated rows go first, as they would fill the places of other ids
    numbered = fine.dropDuplicates(["vec_id", "v"]).withColumn("__h", F.xxhash64("v")).withColumn("__r", F.row_number().over(Window.partitionBy("__h").orderBy("vec_id"))).where(F.col("__r") <= k + 1)
    distinct = written(numbered.groupBy("__h", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select("v", "ids"), "vectors")
    n = distinct.count()
    sample = smallest(distinct, n, sample_rows, seed)
    least = max(4, int(leaf_rows * len(sample) / max(n, 1)))
    rng = np.random.default_rng(seed)
    forest = [grown(sample, least, rng) for _ in range(trees)]
    leaves = max(leaves, math.ceil(leaf_share * sum(len(tree.cut) + 1 for tree in forest)))
    width = 4 if distinct.schema["v"].dataType.elementType == FloatType() else 8
    shards = max(1, math.ceil(width * sample.size / max(len(sample), 1) * n / SHARD_BYTES))
    groups = min(trees, math.ceil(TASKS / shards))
    shard = F.pmod(F.xxhash64("v", F.lit(seed + 1)), F.lit(shards))
    rows = distinct.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    rows = rows.select((shard * groups + F.col("group")).cast("int").alias("part"), "v", "ids")
    asked = fine.where(is_query).repartition(parts, "vec_id").dropDuplicates(["vec_id"]).select("v", "vec_id")
    asked = asked.mapInArrow(_routed_queries(forest, leaves), f"v {asked.schema['v'].dataType.simpleString()}, {ASKED_DDL}")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards * groups - 1))))
    dealt = rows.unionByName(asked, allowMissingColumns=True).repartitionById(shards * groups, F.col("part")).sortWithinPartitions("part", F.col("query").asc_nulls_first())
    found = dealt.mapInArrow(_ranked(forest, groups, k), "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
