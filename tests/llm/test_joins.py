"""Jaccard join, decontamination and repeated-passage removal against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fleetsight.llm import decontaminate, jaccard_join, suffix_dedup
from fleetsight.llm.components import components
from fleetsight.llm.fm_index import FMIndex
from fleetsight.llm.induced_sort import common_prefixes, suffix_array


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    by_gram = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by_gram[g].append(i)
    shared = Counter((a, b) for ids in by_gram.values() for a in ids for b in ids if a < b)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_components_of_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents).collect()}
    assert got == brute_components(rows)


def test_near_copies_that_no_single_hub_links(spark):
    """A chain of drifting copies, frequent shingles and a passage that many short texts share."""
    words = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(30):  # neighbours link, the ends do not
        words[(2 * k) % 80] = f"x{k}"
        rows.append((100 + k, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(300 + k, f"{passage} " + " ".join(f"t{k}-{j}" for j in range(k % 13))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_near_copies_around_the_threshold(spark, monkeypatch):
    """Variants of one text that link with some of the others only, with and without the text itself."""
    rng = np.random.default_rng(8)
    rows = []
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(120)]
        for v in range(60):
            own = list(words)
            for k in rng.choice(120, rng.integers(1, 6), replace=False):
                own[k] = f"v{rng.integers(9)}"
            rows.append((1000 * base + v, " ".join(own)))
        if base:
            rows.append((1000 * base + 500, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for rounds in (0, 1, 3):
        monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", rounds)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()} == want


def test_bitmaps_never_rule_out_more_than_differs():
    rng = np.random.default_rng(9)
    for n in (1, 30, 400, 5000):
        a = rng.integers(-(2**63), 2**63 - 1, n)
        b = np.r_[a[: n // 2], rng.integers(-(2**63), 2**63 - 1, n // 3)]
        bits = sum(int(x).bit_count() for x in (jaccard_join.bitmap(a) ^ jaccard_join.bitmap(b)).view(np.uint64))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_join_of_awkward_rows(awkward, nothing):
    got = sorted(map(tuple, jaccard_join.jaccard_components(awkward).collect()), key=str)
    assert len(got) == 10
    by_id = {r[0]: r for r in got}
    assert by_id[1][1:3] == (0, 1) and by_id[2][1:3] == (0, 2) and by_id[3][1:3] == (0, 3)
    assert by_id[6][2:] == (5, 3) and by_id[9][1:3] == (1, 9) and by_id[8][1] == 1
    assert by_id[None][2] is None
    assert jaccard_join.jaccard_components(nothing).count() == 0
    kept = jaccard_join.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, None, 5, 5, 7, 8, 9])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (200, 201)], "src long, dst long")
    assert {tuple(r) for r in components(edges).collect()} == {(k, 0) for k in range(41)} | {(200, 200), (201, 200)}


def brute_hits(rows, items, width=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(str(item))
    out = Counter()
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= items_here
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("block", [4_000_000, 1_000])
def test_decontamination(spark, documents, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = decontaminate.contamination(decontaminate.find_benchmark(documents, benchmark, ["doc_id"]))
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert got == brute_hits(rows, [tuple(r) for r in benchmark.collect()])


def test_decontamination_of_awkward_rows(spark, awkward, nothing):
    items = [(1, "word word"), (2, "SAME words"), (3, None), (4, ""), (5, "two rows of one id"), (5, "two rows of one id"), (10, "in two, rows")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(decontaminate.find_benchmark(awkward, benchmark, ["doc_id"]))
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())
    assert got == brute_hits([tuple(r) for r in awkward.select("doc_id", "text").collect()], items)
    assert decontaminate.find_benchmark(nothing, benchmark, ["doc_id"]).count() == 0
    none = decontaminate.find_benchmark(awkward, benchmark.where("false"), ["doc_id"])
    assert {r.n_hit for r in none.collect()} == {0}
    kept = decontaminate.keep_uncontaminated(awkward, benchmark)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 7, 9}


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    runs = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(40)] + [np.ones(25, np.int64)] * 3
    text = np.concatenate([np.r_[r, 0] for r in runs]).astype(np.int64)
    index = FMIndex(text, 3)
    for n in (1, 2, 5):
        patterns = np.array([p for p in np.ndindex(*(3,) * n)]) + 1
        lo, hi = index.search(patterns, np.full(len(patterns), n))
        for p, a, b in zip(patterns, lo, hi):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for trial in range(60):
        data = rng.integers(0, [2, 4, 255][trial % 3], rng.integers(1, 200), dtype=np.uint8)
        if trial % 4 == 0:
            data = np.tile(data, 3)
        raw = data.tobytes()
        want = sorted(range(len(raw)), key=lambda k: raw[k:])
        sa = suffix_array(data)
        assert sa.tolist() == want
        shared = common_prefixes(data, sa)
        for a, b in zip(want, want[1:]):
            n = 0
            while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert shared[b] == n


def brute_removal(rows, length):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[a : a + length] for a in range(len(data) - length + 1))
    out = Counter()
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            if seen[data[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def removal(df, **kw):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, **kw).collect())


@pytest.mark.parametrize("crowd", [2_000, 3])
def test_repeated_passages(documents, monkeypatch, crowd):
    """Also with anchors so crowded that they are split by longer grams."""
    monkeypatch.setattr(suffix_dedup, "ANCHOR_CONTEXTS", crowd)
    some = documents.where("length(text) < 4000")
    rows = [tuple(r) for r in some.select("doc_id", "text").collect()]
    assert removal(some, length=60) == brute_removal(rows, 60)


def test_repeats_of_awkward_rows(awkward, nothing):
    short = awkward.where("doc_id <> 8 or doc_id is null")
    rows = [tuple(r) for r in short.select("doc_id", "text").collect()]
    assert removal(short, length=40) == brute_removal(rows, 40)
    long = next(r for r in suffix_dedup.remove_repeats(awkward).collect() if r.doc_id == 8)
    assert long.n_removed == long.n_bytes == 300_000
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def context_rows(texts, length, gram):
    """Contexts of all texts by anchor, as they reach a shard."""
    anchors, found = suffix_dedup.Anchors(length, gram), defaultdict(dict)
    for data in texts:
        for columns in suffix_dedup._contexts_of(data, anchors):
            for anchor, ctx, first, windows, place in zip(*(c.tolist() for c in columns)):
                body = data[first : first + windows + length - 1]
                row = found[anchor].setdefault(ctx, {"anchor": anchor, "ctx": ctx, "n": 0, "windows": windows, "place": place, "body": body})
                row["n"] += 1
    return {a: list(rows.values()) for a, rows in found.items()}


@pytest.mark.parametrize(("length", "gram"), [(60, 24), (60, 8), (40, 38)])
def test_only_windows_that_others_may_hold_reach_a_suffix_array(length, gram, monkeypatch):
    """No repeated window is left out, contexts without a partner are, and the runs are those of brute force."""
    rng = random.Random(5)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(300)) for _ in range(6)]
    texts = [*base, base[0]]
    for _ in range(30):
        copy = bytearray(rng.choice(base))
        for at in rng.sample(range(len(copy)), rng.randint(1, 6)):
            copy[at] = ord("X")
        texts.append(bytes(copy))
    groups = {a: rows for a, rows in context_rows(texts, length, gram).items() if len(rows) > 1}
    counts = Counter(data[a : a + length] for data in texts for a in range(len(data) - length + 1))
    given = []
    real = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda bodies, weights, n: given.extend(bodies) or real(bodies, weights, n))
    batch = pa.RecordBatch.from_pylist([r for rows in groups.values() for r in rows], schema=suffix_dedup.BODY)
    got = {(r["anchor"], r["ctx"]): r["runs"] for b in suffix_dedup._shards(length, gram)(iter([batch])) for r in b.to_pylist()}
    every = 0
    for anchor, rows in groups.items():
        spans = suffix_dedup.shared_windows(rows, length, gram)
        for r, span in zip(rows, spans):
            again = [counts[r["body"][a : a + length]] > 1 for a in range(r["windows"])]
            assert got.get((anchor, r["ctx"]), []) == suffix_dedup._covered_runs(np.array(again), length)
            if r["n"] == 1:
                assert all(span and span[0] <= a <= span[1] for a, x in enumerate(again) if x)
            every += len(r["body"])
    assert 0 < sum(map(len, given)) < 0.9 * every


def test_texts_without_an_id_stay_apart(spark):
    first, second = (" ".join(f"{w}{k}" for k in range(60)) for w in "ab")
    rows = [(1, first), (2, second), (None, first + " x"), (None, second + " y"), (7, first + " z"), (7, second + " z"), (8, "c d e f g h"), (9, "i j k l m n")]
    rows += [(8, "o p q r s t"), (None, "u v w x y z"), (None, "1 2 3 4 5 6")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df).collect())
    assert got == Counter([(1, 1), (2, 2), (None, 1), (None, 2), (7, 1), (7, 2), (8, 8), (8, 8), (9, 9), (None, None), (None, None)])
    kept = Counter(r.doc_id for r in jaccard_join.one_of_each(df).collect())
    assert kept == Counter({1: 1, 2: 1, 8: 2, 9: 1, None: 4})
