"""Fill-in-middle and byte-level BPE against brute force and the tokenizer library."""

import base64
import hashlib
import random
import re
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fleetsight.llm import byte_bpe, fill_middle
from fleetsight.llm.queries import op11_fill_middle, op12_byte_bpe

SMALL = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_fim(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LINES = ["", "\n", "\n\n\n", "a", "a\n", "a\nb", "a\r\nb\rc\n", "<P>\nx", "<\nP>\nS>\nM>\n<", "<S\n<\n", "é\n𝄞 x\n\x0b\n", "x\n" * 5000, "\x00\n\x00"]


def test_fill_middle_equals_brute_force(spark, documents):
    rows = [(k, t) for k, t in enumerate(LINES * 5)] + [(None, "a\nb\nc"), (3, None), (3, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    for percent, spm in ((100, 50), (60, 0), (0, 50), (100, 100)):
        made = fill_middle.transform(docs, percent=percent, spm_percent=spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
        got = sorted(map(tuple, made.collect()), key=repr)
        want = sorted(((i, *brute_fim(i, t, percent, spm), t or "") for i, t in map(tuple, docs.collect())), key=repr)
        assert got == want


def test_fill_middle_of_awkward_rows(awkward, nothing):
    got = fill_middle.transform(awkward)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and got.count() == 10
    assert fill_middle.transform(nothing).count() == 0
    text_ids = fill_middle.transform(awkward.withColumn("doc_id", F.concat(F.lit("c"), "doc_id")))
    assert {r.doc_id for r in text_ids.collect()} == {f"c{k}" for k in range(1, 10) if k != 4} | {None}


def test_fill_middle_slices_long_batches(spark, monkeypatch):
    rows = [(k, f"line {k}\n" * (k % 50)) for k in range(300)]
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 1000)
    cut = fill_middle._transformer(fill_middle.Marks(), 100, 50, None)
    import pyarrow as pa

    ids, text = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(text)], ["a", "b"])
    parts = list(fill_middle._slices(batch, 1))
    assert cut and len(parts) > 20 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_marks_that_could_move_are_refused(documents):
    for marks in (("aba", "x", "y"), ("", "x", "y"), ("x", "x", "y"), ("aa", "x", "y")):
        with pytest.raises(ValueError):
            fill_middle.transform(documents, marks=fill_middle.Marks(*marks))


def test_fill_middle_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in op11_fill_middle(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        n, form, p, m, out = brute_fim(r.doc_id, r.text)
        assert got[r.doc_id] == (n, form, p, m, sha(out), sha(r.text or ""))


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


WORDS = ["", " ", "  ", "   x", "\n\n a", "it's THE'S don't", "x" * 3000, "ab" * 700, "héllo wörld ñ", "中文字符和词", "🙂🙂👩‍👩‍👧", "\x00\x01\x1c\x1d\x85 ", "1234567890 12", "áé", "<|endoftext|>", " \t　mixed  ", "!?…—«»", "ﷺ" * 40, " " * 500]


def test_words_merge_as_the_library_does(ranks, library):
    rng = random.Random(5)
    made = ["".join(rng.choice("aabcdeé🙂 '\n1") for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in WORDS + made:
        for word in re.findall(r"\S+|\s+", text):
            assert byte_bpe.encode_word(word.encode(), ranks) == library._encode_single_piece(word.encode())


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encoding_equals_the_library(spark, documents, ranks, library, monkeypatch):
    rows = [(k, t) for k, t in enumerate(WORDS)] + [(None, "no id"), (3, None), (3, "an id twice"), (3, "an id twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    got = sorted(map(tuple, byte_bpe.decode(encoded, ranks).select("doc_id", "n_tokens", "ids", "decoded").collect()), key=repr)
    want = []
    for i, t in map(tuple, docs.collect()):
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), packed(ids), (t or "").encode()))
    assert got == sorted(want, key=repr)


def test_many_small_blocks(ranks, library, monkeypatch):
    """Blocks, long texts read in runs, and ids put in place piece by piece, without Spark's batching."""
    import pyarrow as pa

    for name, value in (("BLOCK_BYTES", 300), ("LONG", 50), ("RUN", 7), ("PLACED", 11)):
        monkeypatch.setattr(byte_bpe, name, value)
    texts = [f"text {k} of a small block, {'word ' * (k % 9)}" for k in range(60)] + ["", None, " "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["a", "b"])
    schema = byte_bpe._shuffled(pa.int64())

    class Shared:
        value = ranks

    rows = [r for b in byte_bpe._tokenizer(public_tokenizers.PATTERN, 5, schema)(iter([batch])) for r in b.to_pylist()]
    assert len({r["block"] for r in rows}) > 10
    again = [r for b in byte_bpe._tokenizer(public_tokenizers.PATTERN, 5, schema)(iter([batch])) for r in b.to_pylist()]
    assert rows == again  # a task that runs again sends the same
    rows.sort(key=lambda r: (r["kind"], r["part"] or 0))
    rows = [r for b in byte_bpe._encoder(Shared, schema)(iter([pa.RecordBatch.from_pylist(rows, schema=schema)])) for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["block"], r["kind"]))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    got = {r["doc_id"]: r["ids"] for b in byte_bpe._placer(out)(iter([pa.RecordBatch.from_pylist(rows, schema=schema)])) for r in b.to_pylist()}
    assert got == {k: packed(library.encode_ordinary(t or "")) for k, t in enumerate(texts)}


def test_bpe_of_awkward_rows(awkward, nothing, ranks):
    encoded = byte_bpe.encode(awkward, ranks, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    assert {r.doc_id: r.n_tokens for r in encoded.collect() if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert encoded.count() == 10
    empty = byte_bpe.encode(nothing, ranks, public_tokenizers.PATTERN)
    assert empty.count() == 0 and byte_bpe.decode(empty, ranks).count() == 0
    kept = byte_bpe.decode(encoded.withColumn("decoded", F.lit("old")).withColumn("source", F.lit("s")), ranks)
    assert kept.columns == ["doc_id", "n_tokens", "source", "ids", "decoded"]


def test_ids_outside_the_vocabulary_end_the_job(spark, ranks):
    odd = spark.createDataFrame([(1, bytearray(packed([3, 60_000])))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="(?i)bounds|token"):
        byte_bpe.decode(odd, ranks).collect()


def test_bpe_query(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in op12_byte_bpe(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), sha(packed(ids)), sha(r.text or ""))


def test_vocabulary_file_is_read_whole(ranks):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        assert len(ranks) == sum(1 for _ in f) and all(bytes([k]) in ranks for k in range(256))
    assert base64.b64encode(b"a")
