"""Benchmark decontamination: an FM-index per shard of documents, searched for every window of the benchmark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetsight.llm.fm_index import FMIndex
from fleetsight.llm.words import letter_words

#: Words of one shard; a longer document is a shard of its own.
SHARD_WORDS = 400_000
#: Characters of benchmark text that are searched for in one pass; a larger benchmark is searched block by block.
BLOCK_CHARS = 4_000_000

#: The name under which the text travels, so that no kept column clashes with it.
TEXT = "__text"
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))),
])


class Windows:
    """The distinct windows of a block of benchmark items, as rows of word numbers."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.words: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in letter_words(text)]
            step = min(width, len(ids))
            for k in range(len(ids) - step + 1 if ids else 0):
                seen.setdefault(tuple(ids[k : k + step]), set()).update(() if item is None else (item,))
        self.items = [sorted(x) for x in seen.values()]
        self.lengths = np.array([len(x) for x in seen], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if len(seen) else 0
        self.rows = np.zeros((len(seen), width), dtype=np.int64)
        for k, x in enumerate(seen):
            self.rows[k, width - len(x) :] = x


def _runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of known words in which a window fits."""
    known = np.r_[0, (ids > 0).astype(np.int8), 0]
    edge = np.diff(known)
    start = np.flatnonzero(edge == 1)
    length = np.flatnonzero(edge == -1) - start
    fits = length >= shortest
    return start[fits], length[fits]


def search_shard(docs: list[np.ndarray], windows: Windows) -> list[tuple[np.ndarray, np.ndarray, set[str]]]:
    """Per document: starts and lengths (in words) of its merged hit spans, and the items found."""
    parts, part_doc, part_off = [], [], []
    for k, ids in enumerate(docs):
        for a, n in zip(*_runs(ids, windows.shortest)):
            parts += [ids[a : a + n], _ZERO]
            part_doc.append(k)
            part_off.append(a)
    empty = np.zeros(0, np.int64)
    out = [(empty, empty, set()) for _ in docs]
    if not parts:
        return out
    text = np.concatenate(parts).astype(np.int64)
    run_start = np.r_[0, np.flatnonzero(text == 0)[:-1] + 1]
    index = FMIndex(text, len(windows.words))
    lo, hi = index.search(windows.rows, windows.lengths)
    found = np.flatnonzero(hi > lo)
    if len(found) == 0:
        return out
    count = (hi - lo)[found]
    which = np.repeat(found, count)
    rows = np.repeat(lo[found] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    at = index.locate(rows)
    run = np.searchsorted(run_start, at, side="right") - 1
    doc = np.asarray(part_doc)[run]
    start = np.asarray(part_off)[run] + at - run_start[run]
    end = start + windows.lengths[which]
    order = np.lexsort((start, doc))
    doc, start, end, which = doc[order], start[order], end[order], which[order]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(doc)]):
        top = np.maximum.accumulate(end[a:b])
        fresh = np.r_[True, start[a + 1 : b] > top[:-1]]
        begins = start[a:b][fresh]
        ends = top[np.r_[np.flatnonzero(fresh)[1:] - 1, b - a - 1]]
        out[doc[a]] = (begins, ends - begins, {x for w in np.unique(which[a:b]) for x in windows.items[w]})
    return out


_ZERO = np.zeros(1, np.int64)


def _merged(starts: np.ndarray, lengths: np.ndarray, earlier: list[dict], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the words that this block or an earlier one has hit."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, np.r_[starts, [x["start"] for x in earlier]].astype(np.int64), 1)
    np.add.at(edges, np.r_[starts + lengths, [x["start"] + x["length"] for x in earlier]].astype(np.int64), -1)
    turn = np.diff(np.r_[0, (np.cumsum(edges[:-1]) > 0).astype(np.int8), 0])
    begins = np.flatnonzero(turn == 1)
    return begins, np.flatnonzero(turn == -1) - begins


def _searcher(windows: Windows, schema: pa.Schema, keep: int, carry: bool):
    """Rows (kept columns, text, and from an earlier block items and spans) to rows with what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = windows.words.get

        def close(rows: list[tuple], docs: list[np.ndarray]) -> pa.RecordBatch:
            made = []
            for row, ids, (starts, lengths, items) in zip(rows, docs, search_shard(docs, windows)):
                if len(row) > keep + 1:
                    starts, lengths = _merged(starts, lengths, row[keep + 2], len(ids))
                    items = items | set(row[keep + 1])
                spans = [{"start": a, "length": n} for a, n in zip(starts.tolist(), lengths.tolist())]
                made.append((*row[: keep + carry], len(ids), int(lengths.sum()), sorted(items), spans))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made), schema)], schema=schema)

        rows, docs, held = [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                words = letter_words(row[keep])
                docs.append(np.fromiter((number(w, 0) for w in words), dtype=np.int32, count=len(words)))
                rows.append(row)
                held += len(words) + 1
                if held >= SHARD_WORDS:
                    yield close(rows, docs)
                    rows, docs, held = [], [], 0
        if rows:
            yield close(rows, docs)

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13) -> DataFrame:
    """The columns ``keep`` and what the benchmark leaves in each row's text.

    ``n_words``; ``n_hit`` words inside an occurrence of a window (``width`` words of an item, or a shorter item whole);
    ``items``, the distinct ids of items with an occurrence, sorted; ``spans``, the maximal hit runs in words. One row per
    input row, repeated rows included. Null text has no words; an item with null text has no window, one with null id
    counts in spans but not in ``items``. An empty benchmark finds nothing. Other columns of either table are ignored;
    names may clash. The benchmark is read in blocks of bounded size, each searched for in one pass.
    """
    source = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    now = docs.select(*keep, F.col(text_col).cast("string").alias(TEXT))
    for b in range(blocks):
        mine = source.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else source
        windows = Windows([tuple(r) for r in mine.collect()], width)
        carried = [*keep, TEXT] if b < blocks - 1 else keep
        fields = [now.schema[c] for c in carried] + list(FOUND)
        out = T.StructType(fields)
        now = now.select(*keep, TEXT, *(["items", "spans"] if b else []))
        now = now.mapInArrow(_searcher(windows, to_arrow_schema(out), len(keep), b < blocks - 1), out)
    return now


def contamination(found: DataFrame) -> DataFrame:
    """Adds ``n_items``, ``items_sha256`` and ``contaminated`` (hit, and at least a twentieth of the words) to the findings."""
    return found.withColumns({
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join("items", ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
    })


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rule of ``contamination`` does not call contaminated, with the columns of ``docs`` as they are."""
    names = [f"__c{k}" for k in range(len(docs.columns))]
    found = find_benchmark(docs.toDF(*names), benchmark, names, text_col=names[docs.columns.index(text_col)])
    return contamination(found).where("not contaminated").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))


def digest(items: list[str]) -> str:
    """The digest that ``contamination`` gives, for one list of ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
