"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by a join with the token-byte table.

1. A task cuts its texts into pre-tokens and keeps, per block of texts, each distinct word once and the words' positions
   as a sequence of numbers (the most frequent word is 0).
2. A block's distinct words go to the part that their hash names, its positions to any part. However often a word
   occurs, a block sends it once, so no hot word gathers more than a row per block.
3. A part encodes each distinct word once and sends the ids back to the blocks that asked.
4. A block puts the ids in place by position, one text after another.

Decoding takes the bytes of every id from the token-byte table (which has as many rows as the vocabulary) and joins them
per text.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fleetsight.llm.stage import shuffle_partitions

#: Bytes of text in one block; one text at least.
BLOCK_BYTES = 16 << 20
#: Parts of the word shuffle per shuffle partition, so that hashing parts to partitions leaves no task without work.
PARTS_A_PARTITION = 4
#: Pre-tokens read at a time from a text of more than LONG characters.
RUN, LONG = 1 << 16, 1 << 20
#: Ids put in place at a time; the ids of one text at least.
PLACED = 2_000_000


def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary file (a line holds a token in base 64 and its rank) as token -> rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: adjacent parts merge, the lowest rank first and of equal ones the leftmost."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, at, to = heapq.heappop(heap)
        middle = end[at]
        if not middle or middle >= to or end[middle] != to:
            continue  # one of the two parts has changed since
        end[at], end[middle] = to, 0
        if to < n:
            before[to] = at
            if (r := ranks.get(word[at : end[to]])) is not None:
                heapq.heappush(heap, (r, at, end[to]))
        if (left := before[at]) >= 0 and (r := ranks.get(word[left:to])) is not None:
            heapq.heappush(heap, (r, left, to))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2**32 by planes of bytes, compressed."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _shuffled(id_type: pa.DataType) -> pa.Schema:
    """kind 0: words (a) with their lengths (b); 1: ids (a) with their numbers (b); 2: positions (a), words per text (b), part per word (c)."""
    return pa.schema([("dest", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("who", pa.list_(id_type))])


def _tokenizer(pattern: str, parts: int, schema: pa.Schema):
    def block_rows(words: dict[str, int], at: array, counts: list[int], who: list) -> Iterator[dict]:
        codes = np.frombuffer(at, np.uint32)
        times = np.bincount(codes, minlength=len(words))
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        every = list(words)
        every = [every[k].encode() for k in order.tolist()]
        part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in every), np.int64, len(every))
        positions, of_text, part_of = _packed(rank[codes]), _packed(np.array(counts)), _packed(part)
        # named by what it holds: a task that runs again names its blocks alike
        held = xxhash.xxh3_64(positions)
        for x in (of_text, part_of, repr(who).encode(), b"\n".join(every)):
            held.update(x)
        rows = {"block": np.uint64(held.intdigest()).view(np.int64).item()}
        by_part = np.argsort(part, kind="stable")
        for group in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1) if every else ():
            mine = [every[k] for k in group.tolist()]
            p = int(part[group[0]])
            yield {**rows, "kind": 0, "dest": p, "part": p, "a": zstandard.compress(b"".join(mine), 3), "b": _packed(np.array([len(w) for w in mine]))}
        yield {**rows, "kind": 2, "dest": rows["block"], "a": positions, "b": of_text, "c": part_of, "who": who}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern)
        words: dict[str, int] = {}
        at, counts, who, held = array("I"), [], [], 0

        def numbered(pieces: list[str]) -> None:
            at.extend([words.setdefault(w, len(words)) for w in pieces])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, before = text.as_py() or "", len(at)
                if len(text) <= LONG:
                    numbered(find.findall(text))
                else:
                    found = (m.group() for m in find.finditer(text))
                    while some := list(islice(found, RUN)):
                        numbered(some)
                counts.append(len(at) - before)
                who.append(i)
                held += len(text) + 100
                if held >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(list(block_rows(words, at, counts, who)), schema=schema)
                    words, at, counts, who, held = {}, array("I"), [], [], 0
        if who:
            yield pa.RecordBatch.from_pylist(list(block_rows(words, at, counts, who)), schema=schema)

    return run


def _encoder(ranks, schema: pa.Schema):
    """Rows of one part after another: its words to ids, each distinct word once. Rows of positions pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now, known = ranks.value, None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if r["part"] != now:
                        now, known = r["part"], {}
                    data, to, ids = zstandard.decompress(r["a"]), 0, []
                    counts = []
                    for size in _unpacked(r["b"]).tolist():
                        word = data[to : to + size]
                        to += size
                        got = known.get(word)
                        if got is None:
                            got = known[word] = encode_word(word, table)
                        ids += got
                        counts.append(len(got))
                    r |= {"kind": 1, "a": _packed(np.array(ids)), "b": _packed(np.array(counts))}
                yield pa.RecordBatch.from_pylist([r], schema=schema)

    return run


def _placer(schema: pa.Schema):
    """Rows of one block after another, its ids before its positions, to the ids of each text."""

    def texts(ids: dict[int, tuple[np.ndarray, np.ndarray]], r: dict) -> Iterator[pa.RecordBatch]:
        part_of, codes = _unpacked(r["c"]), _unpacked(r["a"])
        order = np.argsort(part_of, kind="stable")  # words by part and, within one, as they were sent
        present = np.unique(part_of).tolist()
        none = np.zeros(0, np.uint32)
        flat = np.concatenate([none, *(ids[p][0] for p in present)])
        size = np.zeros(len(part_of), np.int64)
        size[order] = np.concatenate([none, *(ids[p][1] for p in present)])
        start = np.zeros(len(part_of), np.int64)
        start[order] = np.r_[0, np.cumsum(size[order])][:-1]
        words_to = np.cumsum(_unpacked(r["b"]).astype(np.int64))
        ids_to = np.r_[0, np.cumsum(size[codes])][words_to]  # where the ids of each text end
        edges = np.flatnonzero(np.diff(ids_to // PLACED)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(words_to)]):
            some = codes[words_to[a - 1] if a else 0 : words_to[b - 1]]
            n = size[some]
            took = flat[np.repeat(start[some] - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(n.sum())] if len(some) else none
            base = ids_to[a - 1] if a else 0
            offsets = np.r_[0, ids_to[a:b] - base] * 4
            data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(took, "<u4"))])
            yield pa.RecordBatch.from_arrays([pa.array(r["who"][a:b], schema.field(0).type), pa.array(np.diff(offsets) // 4), data], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != now:
                    now, ids = r["block"], {}
                if r["kind"] == 1:
                    ids[r["part"]] = (_unpacked(r["a"]), _unpacked(r["b"]))
                else:
                    yield from texts(ids, r)

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids`` (packed as little-endian unsigned 32-bit integers).

    Each match of ``pattern`` is encoded by itself; ``ranks`` has to hold all single bytes. Null and empty texts have no
    ids. Ids of rows may have any type, be null or repeat; repeated rows come back repeated. Extra columns are ignored.
    An empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    schema = _shuffled(to_arrow_type(kind))
    ddl = f"dest long, kind int, block long, part long, a binary, b binary, c binary, who array<{kind.simpleString()}>"
    parts = shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary, whatever the texts
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_tokenizer(pattern, parts * PARTS_A_PARTITION, schema), ddl)
    encoded = rows.repartition(parts, "dest").sortWithinPartitions("kind", "part").mapInArrow(_encoder(shared, schema), ddl)
    out = pa.schema([(id_col, to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    by_block = encoded.repartition(parts, "block").sortWithinPartitions("block", "kind")
    return by_block.mapInArrow(_placer(out), f"`{id_col}` {kind.simpleString()}, n_tokens long, ids binary")


def _decoder(tokens, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(tokens.value, pa.large_binary())
        lengths = np.diff(np.frombuffer(table.buffers()[1], np.int64, len(table) + 1))
        for batch in batches:
            packed = batch.column(batch.num_columns - 1)
            at = 0
            while at < len(packed):
                some, held = [], 0
                while at + len(some) < len(packed) and held < 4 * PLACED:
                    some.append(packed[at + len(some)].as_py() or b"")
                    held += len(some[-1])
                ids = np.frombuffer(b"".join(some), "<u4")
                joined = table.take(pa.array(ids))
                if joined.null_count:
                    raise ValueError("an id stands for no token")
                bytes_to = np.r_[0, np.cumsum(lengths[ids])]
                offsets = bytes_to[np.cumsum([0, *map(len, some)]) // 4]
                first = np.frombuffer(joined.buffers()[1], np.int64)[0] if len(ids) else 0
                data = joined.buffers()[2].slice(int(first)) if len(ids) else pa.py_buffer(b"")
                texts = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int32)), data])
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(some)).columns, texts], schema=schema)
                at += len(some)

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its packed ids in ``bytes_col``; null and empty ids have none.

    An id outside the vocabulary ends the job. Other columns stay; one named ``bytes_col`` is replaced. The bytes of one
    row have to stay below 2 GB.
    """
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    others = [c for c in encoded.columns if c not in (ids_col, bytes_col)]
    rows = encoded.select(*others, ids_col)
    schema = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in rows.schema), (bytes_col, pa.binary())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{bytes_col}` binary"
    return rows.mapInArrow(_decoder(shared, schema), ddl)
