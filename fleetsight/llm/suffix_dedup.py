"""Removal of byte strings that occur again anywhere in the corpus, by suffix arrays over shards of shared passages.

Every window of ``length`` bytes picks an anchor, the smallest hash among its ``gram``-byte substrings. Equal windows pick
equal anchors, so a window whose anchor occurs once occurs once. The windows of one anchor occurrence are adjacent: their
bytes are its context. Contexts are compared by digest first; anchors with differing contexts send one copy of each to a
shard, whose suffix array and common prefixes tell which windows occur again. Windows that no other context of the anchor
can hold, as the bytes they share with their neighbours occur in none, stay out of the array. An anchor with more differing contexts than
a shard should hold is split by longer grams, up to the whole window, where equal means the same string.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.induced_sort import common_prefixes, suffix_array
from fleetsight.llm.stage import shuffle_partitions, written
from fleetsight.llm.words import mixed

#: Windows whose anchors are found at a time, so that a huge text needs bounded memory.
SEGMENT = 1 << 20
#: Bytes of contexts in one suffix array.
SHARD_BYTES = 1_500_000
#: Differing contexts of one anchor beyond which it is split by longer grams.
ANCHOR_CONTEXTS = 2_000
#: Groups of neighbouring windows of an anchor that are looked up in its other contexts.
CELLS = 16
#: Never a byte of UTF-8.
SEPARATOR = b"\xff"

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Anchors:
    """Anchors of all windows of a text."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.room = length, gram, length - gram + 1
        self.up = self.down = np.zeros(0, np.uint64)

    def _grams(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[:n], out=total[1:])
        return mixed((total[self.gram :] - total[: n - self.gram + 1]) * self.down[: n - self.gram + 1])

    def of(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor hash, first window, number of windows, anchor behind the first) of each maximal run of windows with one anchor."""
        for base in range(0, len(data) - self.length + 1, SEGMENT):
            part = data[base : base + SEGMENT + self.length - 1]
            grams = self._grams(part)
            # ties between equal grams go to the leftmost: the position fills the low bits
            key = (grams & np.uint64(0xFFFFFF0000000000)) >> np.uint64(0) | (grams & np.uint64(0xFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
            w, n = self.room, len(part) - self.length + 1
            pad = -len(key) % w
            blocks = np.r_[key, np.full(pad, np.uint64(2**64 - 1))].reshape(-1, w)
            left = np.minimum.accumulate(blocks, axis=1).ravel()
            right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            low = np.minimum(right[:n], left[w - 1 : w - 1 + n])
            pos = (low & np.uint64(0xFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
            yield grams[pos[first]], first + base, np.diff(np.r_[first, n]), pos[first] - first


OCC = pa.schema([("did", pa.int64()), ("kh", pa.int64()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("place", pa.int32())])


def _contexts_of(data: bytes, anchors: Anchors) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, digest of the context, first window, number of windows, place of the anchor in the context)."""
    digest = xxhash.xxh3_64_intdigest
    reach = anchors.length - 1
    for anchor, first, windows, place in anchors.of(np.frombuffer(data, np.uint8)):
        ctx = np.fromiter((digest(data[a : a + n + reach]) for a, n in zip(first.tolist(), windows.tolist())), np.uint64, len(first))
        yield anchor.view(np.int64), ctx.view(np.int64), first, windows, place


def _occurrences(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in OCC]
            for did, kh, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = (text.as_py() or "").encode()
                if len(data) < length:
                    continue
                for anchor, ctx, *places in _contexts_of(data, anchors):
                    ids = (np.full(len(anchor), x, np.int64) for x in (did, kh))
                    for c, x in zip(cols, (*ids, anchor, ctx, *(x.astype(np.int32) for x in places))):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=OCC)

    return run


BODY = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64()), ("windows", pa.int32()), ("place", pa.int32()), ("body", pa.binary())])


def _cut(length: int):
    """Documents with the contexts wanted of them to the bytes of those contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode()
                made = [{**w, "body": data[w["start"] : w["start"] + w["windows"] + length - 1]} for w in wanted.as_py()]
                yield pa.RecordBatch.from_pylist(made, schema=BODY)

    return run


SPLIT = pa.schema([("pa", pa.int64()), ("pc", pa.int64()), ("off", pa.int32()), *BODY])


def _split(length: int, gram: int):
    """Contexts to the smaller contexts of longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                for found in _contexts_of(r["body"], anchors):
                    for a, c, f, w, p in zip(*(x.tolist() for x in found)):
                        made.append({"pa": r["anchor"], "pc": r["ctx"], "off": f, "anchor": a, "ctx": c, "n": r["n"], "windows": w, "place": p, "body": r["body"][f : f + w + length - 1]})
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=SPLIT)

    return run


RUNS = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("runs", pa.list_(pa.struct([("off", pa.int32()), ("len", pa.int32())])))])
RUNS_DDL = "anchor long, ctx long, runs array<struct<off:int,len:int>>"


def _covered_runs(repeated: np.ndarray, length: int) -> list[dict]:
    """Byte runs covered by the windows that start at the flagged positions."""
    at = np.flatnonzero(repeated)
    if len(at) == 0:
        return []
    fresh = np.r_[True, at[1:] > at[:-1] + length]
    last = at[np.r_[np.flatnonzero(fresh)[1:] - 1, len(at) - 1]]
    return [{"off": a, "len": b + length - a} for a, b in zip(at[fresh].tolist(), last.tolist())]


def repeated_windows(bodies: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """Per body: which of its windows occur again in any body, or in a body that stands for several."""
    data = np.frombuffer(SEPARATOR.join(bodies) + SEPARATOR, np.uint8)
    sa = suffix_array(data)
    prefixes = common_prefixes(data, sa)
    sizes = np.array([len(b) + 1 for b in bodies])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    weight = np.zeros(len(data), np.int64)
    for a, size, w in zip(starts, sizes, weights):
        weight[a : a + size - length] = w
    group = np.cumsum(prefixes[sa] < length) - 1
    total = np.bincount(group, weights=weight[sa])
    again = np.zeros(len(data), bool)
    again[sa] = total[group] >= 2
    again &= weight > 0
    return [again[a : a + size - length] for a, size in zip(starts, sizes)]


def shared_windows(contexts: list[dict], length: int, gram: int) -> list[tuple[int, int] | None]:
    """Per context of one anchor: first and last window that another of them may hold, None if there is none.

    Equal windows have the anchor at one place. So windows with the anchor at neighbouring places form a cell, and a
    window can only occur in contexts that hold the bytes common to all windows of its cell.
    """
    step = max(1, (length - gram + 1) // CELLS)
    core = length - step + 1
    seen: Counter[tuple[int, bytes]] = Counter()
    cells = []
    for r in contexts:
        place, body = r["place"], r["body"]
        low = place - r["windows"] + 1
        mine = [(t, body[place - t : place - t + core]) for t in range(low - low % step, place + 1, step)]
        seen.update(mine)
        cells.append(mine)
    out: list[tuple[int, int] | None] = []
    for r, mine in zip(contexts, cells):
        held = [t for t, core in mine if seen[t, core] > 1]
        out.append((max(0, r["place"] - held[-1] - step + 1), min(r["windows"] - 1, r["place"] - held[0])) if held else None)
    return out


def _shards(length: int, gram: int):
    """Contexts, those of one anchor after another, to the runs of bytes covered by repeated windows."""

    def made(r: dict, first: int, runs: list[dict]) -> dict:
        return {"anchor": r["anchor"], "ctx": r["ctx"], "runs": [{"off": x["off"] + first, "len": x["len"]} for x in runs]}

    def searched(held: list[tuple[dict, int, bytes]]) -> pa.RecordBatch:
        found = repeated_windows([b for _, _, b in held], [r["n"] for r, _, _ in held], length)
        rows = [made(r, first, runs) for (r, first, _), again in zip(held, found) if (runs := _covered_runs(again, length))]
        return pa.RecordBatch.from_pylist(rows, schema=RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict, int, bytes]] = []  # context, first window, bytes that go into the array
        size = 0
        for _, rows in groupby((r for batch in batches for r in batch.to_pylist()), itemgetter("anchor")):
            group = list({r["ctx"]: r for r in rows}.values())
            alone = []
            for r, span in zip(group, shared_windows(group, length, gram)):
                if r["n"] > 1 and span is None:
                    alone.append(made(r, 0, [{"off": 0, "len": len(r["body"])}]))
                elif span is not None:
                    first, last = span if r["n"] == 1 else (0, r["windows"] - 1)
                    held.append((r, first, r["body"][first : last + length]))
                    size += len(held[-1][2]) + 1
            if alone:
                yield pa.RecordBatch.from_pylist(alone, schema=RUNS)
            if size >= SHARD_BYTES:
                yield searched(held)
                held, size = [], 0
        if held:
            yield searched(held)

    return run


def _next_gram(length: int, gram: int) -> int:
    """Half as many places for the gram in a window, down to one."""
    return length - (length - gram) // 2


def _resolved(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of bytes covered by repeated windows, per (anchor, ctx) of ``contexts(anchor, ctx, n, windows, body)``."""
    parts = shuffle_partitions(contexts.sparkSession)
    sizes = contexts.groupBy("anchor").agg(F.count("*").alias("k"))
    crowded = written(sizes.where(F.col("k") > ANCHOR_CONTEXTS).select("anchor"), "suffix-crowded")
    if crowded.isEmpty() or gram >= length:
        rest, hot = contexts, None
    else:
        rest = contexts.join(crowded, "anchor", "left_anti")
        hot = contexts.join(crowded, "anchor", "left_semi")
    found = rest.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_shards(length, gram), RUNS_DDL)
    if hot is None:
        return found
    finer = _next_gram(length, gram)
    sub = written(hot.mapInArrow(_split(length, finer), "pa long, pc long, off int, anchor long, ctx long, n long, windows int, place int, body binary"), "suffix-split")
    distinct = sub.groupBy("anchor", "ctx").agg(F.sum("n").alias("n"), F.max("windows").alias("windows"), F.max("place").alias("place"), F.max("body").alias("body"))
    several = distinct.groupBy("anchor").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("total > 1")
    distinct = written(distinct.join(several, "anchor"), "suffix-finer")
    inner = _same(distinct.where("k = 1"), length).unionByName(_resolved(distinct.where("k > 1").drop("k", "total"), length, finer))
    back = sub.select("pa", "pc", "off", "anchor", "ctx").join(inner, ["anchor", "ctx"])
    moved = back.select("pa", "pc", F.expr("transform(runs, r -> named_struct('off', r.off + off, 'len', r.len))").alias("runs"))
    merged = moved.groupBy("pa", "pc").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return found.unionByName(merged.select(F.col("pa").alias("anchor"), F.col("pc").alias("ctx"), "runs"))


def _same(contexts: DataFrame, length: int) -> DataFrame:
    """A context that occurs again as a whole: all its bytes."""
    run = F.struct(F.lit(0).alias("off"), (F.col("windows") + (length - 1)).alias("len"))
    return contexts.where("n > 1").select("anchor", "ctx", F.array(run).alias("runs"))


CUT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), ("kept", pa.binary())])


def _removed(with_kept: bool):
    schema = pa.schema([("doc_id", pa.int64()), *list(CUT)[: 6 if with_kept else 5]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                spans: list[list[int]] = []
                for r in sorted(((r["off"], r["off"] + r["len"]) for r in runs.as_py() or ())):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = {"doc_id": doc_id, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": a, "length": b - a} for a, b in spans]}
                made.append({**row, "kept": kept} if with_kept else row)
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int | None = None, with_kept: bool = False) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (byte start and length).

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same text or another;
    strings are judged on the input. ``with_kept`` adds the bytes that stay. Null and empty texts have no bytes. Repeated
    rows are texts of their own, so all of a copied text of ``length`` bytes or more goes. A null id is kept as null.
    Extra columns are ignored.
    """
    gram = gram or max(1, length * 2 // 5)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = named.withColumns({"did": F.coalesce("doc_id", F.lit(-1)), "kh": F.xxhash64("text")})
    occ = written(keyed.select("did", "kh", "text").mapInArrow(_occurrences(length, gram), "did long, kh long, anchor long, ctx long, start int, windows int, place int"), "suffix-anchors")
    # counts are written, so that both sides of a join by anchor are plain shuffles and AQE can split a hot anchor
    again = written(occ.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "suffix-counts")
    occ = written(occ.join(again, "anchor"), "suffix-again")
    distinct = occ.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("did", "kh", "start", "windows", "place")).alias("at"))
    distinct = distinct.select("anchor", "ctx", "n", "at.*")
    distinct = written(distinct, "suffix-distinct")
    several = written(distinct.groupBy("anchor").agg(F.count("*").alias("k")), "suffix-several")
    distinct = written(distinct.join(several, "anchor"), "suffix-contexts")
    wanted = distinct.where("k > 1").groupBy("did", "kh").agg(F.collect_list(F.struct("anchor", "ctx", "n", "start", "windows", "place")).alias("wanted"))
    bodies = written(keyed.join(wanted, ["did", "kh"]).select("text", "wanted").mapInArrow(_cut(length), "anchor long, ctx long, n long, windows int, place int, body binary"), "suffix-bodies")
    runs = _same(distinct.where("k = 1"), length).unionByName(_resolved(bodies, length, gram))
    placed = occ.join(runs, ["anchor", "ctx"]).select("did", "kh", F.expr("transform(runs, r -> named_struct('off', r.off + start, 'len', r.len))").alias("runs"))
    by_doc = placed.groupBy("did", "kh").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,length:int>>" + ", kept binary" * with_kept
    return keyed.join(by_doc, ["did", "kh"], "left").select("doc_id", "text", "runs").mapInArrow(_removed(with_kept), ddl)
