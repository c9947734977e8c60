"""Toxicity, quality, personal data, neighbours: held-out accuracy, brute force and awkward rows."""

import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetsight.llm import crf, neighbours, pii, quality, toxicity

MEDIUM = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


def auc(pairs):
    high, low = (np.array([s for s, y in pairs if bool(y) == want]) for want in (True, False))
    return ((high[:, None] > low).mean() + (high[:, None] >= low).mean()) / 2


def brute_segments(scores):
    """Recursive definition: the best segment, then what is left of it and right of it."""
    if not scores:
        return []
    total = [0, *itertools.accumulate(scores)]
    best = max(((total[b] - total[a], -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return brute_segments(scores[:a]) + [(a, b - 1, best[0])] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_maximal_segments():
    rng = np.random.default_rng(4)
    for _ in range(200):
        weights = [float(w) for w in rng.choice([0, 0, 0, 5, -3, 2.5, -7], 14)]
        scores = [w - 1.0 for w in weights]
        hits = [(k, w) for k, w in enumerate(weights) if w]
        want = [s for s in brute_segments(scores)]
        got = toxicity.maximal_segments(hits, len(weights), drift=1.0)
        assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in want))
        assert len(got) == len(want)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.learnable(docs), labels)
    scored = toxicity.score(docs, model, ["doc_id"]).withColumn("h", toxicity.held_out("doc_id"))
    rows = scored.join(labels, "doc_id").where("h").select("score", "toxic").collect()
    assert auc(rows) > 0.9
    assert sum((r.score >= 0.5) == r.toxic for r in rows) > 0.95 * len(rows)
    assert scored.count() == docs.count()


def test_toxicity_of_awkward_rows(spark, awkward, nothing, labels):
    train = spark.createDataFrame([(k, "you utter idiot " * 3 if k % 2 else "a fine day in the park") for k in range(200)], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (3, None), (5, 1), (5, 1)], "doc_id long, toxic int")
    model = toxicity.fit(train, known)
    got = {r.doc_id: r for r in toxicity.score(awkward, model, ["doc_id"]).collect()}
    assert len(got) == 9 and all(0 <= r.score < 0.5 and not r.passages for r in got.values())
    bad = spark.createDataFrame([(1, "It is so: YOU utter idiot, and more of the same"), (2, "a fine day")], "doc_id long, text string")
    first, second = (r for r in toxicity.score(bad, model, ["doc_id"]).orderBy("doc_id").collect())
    assert first.score > 0.5 > second.score
    passage = first.passages[0]
    assert "It is so: YOU utter idiot, and more of the same"[passage.start : passage.start + passage.length] == "YOU utter idiot"
    assert toxicity.keep_clean(bad, model).select("doc_id").collect()[0][0] == 2
    assert toxicity.score(nothing, model, ["doc_id"]).count() == 0
    blank = toxicity.fit(nothing, labels)
    assert len({r.score for r in toxicity.score(awkward, blank, ["doc_id"]).collect()}) >= 1


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.where(~quality.held_out("doc_id")), labels)
    rows = quality.score(docs, model).withColumn("h", quality.held_out("doc_id")).join(labels, "doc_id").where("h").select("score", "quality").collect()
    assert auc(rows) > 0.85


def test_quality_of_awkward_rows(awkward, nothing, labels):
    model = quality.fit(nothing, labels)
    got = quality.score(awkward, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(nothing, model).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m.group())]
            doubled = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
            fits = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_patterns():
    rng = np.random.default_rng(5)
    for _ in range(2_000):
        text = "".join(rng.choice(list("1234567890.. +-()@a b%"), 40))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("4111 1111-1111 1111") == [("card", 0, 19)]
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.{zeros}255.1.2") == [("ip", 0, 10008)]
    assert pii.base_spans(f"{'9' * 5000}.1.2.3 +{'1' * 5000}") == []


def test_personal_data_of_documents(documents):
    texts = dict(documents.select("doc_id", "text").collect())
    for r in pii.find(documents, ["doc_id"]).collect():
        base = brute_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in PATTERNS)


def test_field_finds_what_the_patterns_miss():
    texts = ["please call (301) 555-7788 today", "it was 1999 and 12.5 percent of 300", "mail +1 (301) 555-7788 or a@b.example"]
    base = [pii.base_spans(t) for t in texts]
    found = pii.field_spans(texts, base, pii.model())
    assert [[texts[k][a:b] for _, a, b in f] for k, f in enumerate(found)] == [["(301) 555-7788"], [], []]
    assert pii.redacted(texts[2], base[2]) == "mail [PHONE] or [EMAIL]"


def test_personal_data_of_awkward_rows(awkward, nothing):
    got = pii.find(awkward, ["doc_id", "k"], redact=True).collect()
    assert len(got) == 10 and all(r.spans == "" for r in got)
    assert {r.doc_id: r.redacted for r in got}[1] is None
    same = pii.redact(awkward)
    assert same.columns == awkward.columns and same.exceptAll(awkward).count() == 0
    assert pii.find(nothing, ["doc_id"]).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(6)
    chain = crf.Chain(["a", "b", "c"], [{"x": 1, "y": 2}], [rng.normal(size=(3, 3))], rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3))
    sequences = [rng.integers(0, 3, (n, 1)).astype(np.int32) for n in (1, 2, 5, 4, 1, 0)]
    for s, path in zip(sequences, chain.viterbi(sequences)):
        e = chain.emissions(s)
        value = lambda p: chain.first[p[0]] + chain.last[p[-1]] + sum(e[t, y] for t, y in enumerate(p)) + sum(chain.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert len(path) == len(s)
        if len(s):
            assert value(list(path)) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(s)))))


def brute_nearest(rows, queries, k):
    out = []
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    return out


def test_neighbours_recall(spark):
    table = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    fine = [(i, v) for i, v in table.select("vec_id", "embedding").collect() if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = brute_nearest(fine, [(i, v) for i, v in fine if i % 100 == 0], 10)
    got = [tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 100 == 0).collect()]
    pairs = lambda rows: {(q, i) for q, _, i, _ in rows}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(want)


def test_neighbours_of_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [2.0, 0.0]), (9, [0.0, 1.0, 2.0]), (None, [1.0, 1.0]), (10, [])]
    rows += [(100 + k, [3.0, 3.0]) for k in range(400)]
    table = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    fine = sorted({(i, tuple(v)) for i, v in rows if i is not None and i not in (3, 4, 5, 6, 7, 9, 10)})
    want = brute_nearest(fine, [(i, v) for i, v in fine if i % 100 == 0], 10)
    got = sorted(tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 100 == 0).collect())
    assert got == want
    assert neighbours.nearest(table.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_field_reads_whole_texts():
    chain, prose = pii.model(), "the story goes on with many plain words and no signs at all " * 20
    texts = [prose + inner + " today. " + prose for inner in ("write to anna at mail.example.com", "mail jo.smith (at) example.org", "email kim [at] blog.example.net")]
    texts += [prose.strip(), "tel " + "(068) 555-2212 and 12 of 300 lines; call " * 400]
    found = pii.field_spans(texts, [[] for _ in texts], chain)
    assert ["example.com" in "".join(texts[k][a:b] for _, a, b in found[k]) for k in range(1)] == [True]
    assert all(len(f) == 1 and f[0][0] == "email" for f in found[:3])
    assert found[3] == [] and [texts[4][a:b] for _, a, b in found[4]] == ["(068) 555-2212"] * 400


def test_coded_rows_are_the_features(documents):
    chain = pii.model()
    coder = pii.Coder(chain)
    texts = [r.text for r in documents.select("text").limit(60).collect()] + ["", "^ $ | a|b +1 ½x 12٣4 _ at@mail.com call-me", *pii.LABELLED]
    for text in texts:
        words, glued, spans = pii.tokenised(text or "")
        rows, starts, ends = coder.rows(text or "")
        assert (rows == chain.rows(pii.features(words, glued))).all() and list(zip(starts, ends)) == spans


def test_neighbours_of_repeated_rows(spark):
    rows = [(k, [1.0, 2.0]) for k in range(30) for _ in range(3)] + [(100 + k, [5.0, 2.0 + k]) for k in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(k, 0.0) for k in range(1, 11)]


def test_leaves_follow_the_table(spark, monkeypatch):
    rng, asked = np.random.default_rng(3), []
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(3_000, 8)))], "vec_id long, embedding array<double>")
    whole = neighbours._routed_queries
    monkeypatch.setattr(neighbours, "_routed_queries", lambda forest, leaves: asked.append((leaves, sum(len(t.cut) + 1 for t in forest))) or whole(forest, leaves))
    for leaf_rows in (150, 5):
        neighbours.nearest(table, F.col("vec_id") < 3, leaves=8, leaf_rows=leaf_rows).count()
    assert asked[1][1] > 8 * asked[0][1] and all(0.04 * total <= leaves < 0.04 * total + 8 for leaves, total in asked)


def heap_opened(forest, q, leaves):
    """(tree, leaf) one after another from a queue of all trees, nodes of a tree in the order in which they were made."""
    turn = lambda t, node: (int(forest[t].turn[node]) if node >= 0 else node, node)
    queue, out = [(0.0, t, *turn(t, 0 if len(tree.cut) else -1)) for t, tree in enumerate(forest)], []
    while queue and len(out) < leaves:
        far, t, _, node = heapq.heappop(queue)
        while node >= 0:
            margin = float(q @ forest[t].normal[node] - forest[t].cut[node])
            side = int(margin > 0)
            heapq.heappush(queue, (max(far, abs(margin)), t, *turn(t, int(forest[t].child[node, 1 - side]))))
            node = int(forest[t].child[node, side])
        out.append((t, ~node))
    return out


def test_queries_do_not_grow_with_the_leaves_they_open():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4_000, 8))
    forest = [neighbours.grown(x, 4, rng) for _ in range(4)]
    total = sum(len(t.cut) + 1 for t in forest)
    asked = pa.record_batch({"v": pa.array(x[:300].tolist(), pa.list_(pa.float64())), "vec_id": pa.array(range(300), pa.int64())})
    sizes = []
    for leaves in (total // 25, total // 2):
        made = list(neighbours._routed_queries(forest, leaves)(iter([asked])))
        assert sum(b.num_rows for b in made) == 300  # before: 300 times the leaves, with the vector each, in one batch
        sizes.append(sum(b.nbytes for b in made))
    assert max(sizes) < 300 * (8 * 8 + 4 * total // 16)


def test_queries_tell_what_their_queue_opens():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1_500, 6))
    forest = [neighbours.grown(x, 8, rng) for _ in range(5)]
    first = np.cumsum([0] + [len(t.cut) + 1 for t in forest])
    for leaves in (1, 4, 5, 6, 40, 300, int(first[-1]) - 1, int(first[-1]), 10**6):
        q = rng.normal(size=(12, 6))
        for v, (under, beyond, tied) in zip(q, neighbours.reached(forest, q, leaves)):
            got = set(tied)
            for t, tree in enumerate(forest):
                far = np.empty((1, len(tree.cut) + 1))
                tree.spread(v[None], far)
                got |= {int(first[t] + leaf) for leaf in tree.lined[~(far[0] >= under)]}
                assert not {int(first[t] + leaf) for leaf in tree.lined[far[0] >= beyond]} & got
            assert got == {int(first[t]) + leaf for t, leaf in heap_opened(forest, v, leaves)}


@pytest.mark.parametrize("kind, scale", [("float", 1.0), ("double", 1.0), ("float", 1e-20), ("float", 1e17)])
def test_neighbours_over_several_shards(spark, monkeypatch, kind, scale):
    rng, seen = np.random.default_rng(7), []
    x = rng.normal(size=(700, 6)) * scale
    x[::9] = x[1]
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    monkeypatch.setattr(neighbours, "SHARD_BYTES", 6_000)
    whole = neighbours._routed_queries
    monkeypatch.setattr(neighbours, "_routed_queries", lambda forest, leaves: seen.append((forest, leaves)) or whole(forest, leaves))
    got = sorted(tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0, trees=4, leaves=8, leaf_rows=10).collect())
    (forest, leaves), want = seen[0], []
    by_tree = [t.leaves(x) for t in forest]
    for q in range(0, 700, 50):
        met = np.zeros(700, bool)
        for t, leaf in heap_opened(forest, x[q], leaves):
            met |= by_tree[t] == leaf
        near = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), int(i)) for i in np.flatnonzero(met) if i != q)[:10]
        want += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    assert leaves < sum(len(t.cut) + 1 for t in forest)
    assert got == want
