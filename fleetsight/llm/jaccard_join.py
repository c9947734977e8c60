"""Exact n-gram Jaccard self-join by vertical partitioning, and the components of its links.

Steps:

1. Every text becomes a set of 64-bit shingle hashes. Equal sets form one class; only classes are compared.
2. The shingles are dealt out by ranges of their hash (the vertical fragments). A fragment sees every posting of its
   shingles, so it knows each shingle's exact document frequency and drops those of one class. A shingle that is
   frequent inside one batch of documents travels as a count to its fragment, its postings in chunks to any task.
3. The global order is (frequency, hash), rarest first. Two sets that link share a shingle among the first
   ``n - ceil(0.75 n) + 1`` of either; a class whose prefix is filled by shingles of its own alone has no links.
4. Within the classes that share a prefix shingle, members are compared with a hub, the class with the largest share of
   shingles that others have too, then with others while the turns find links, and at last across the components that
   are left, so no link between two components can be missed. A pair leaves the join only if what follows the shingle
   in both sets can make up the overlap and if the bitmaps of the two sets do not rule it out: with a parity bit per
   hash bucket, the bits in which they differ are a lower bound of the shingles that only one of them has.
5. A compared pair's overlap is the sum of partial overlaps, one per vertical fragment of the two sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.components import components
from fleetsight.llm.stage import forget, shuffle_partitions, written
from fleetsight.llm.words import WordHashes, gram_hashes, mixed, spaced_words

#: Shingles packed by a task before it hands them on.
FLUSH = 400_000
#: A shingle that so many classes of one flush share is sent as a count; its postings go round the fragment.
FREQUENT = 64
#: Vertical fragments in which the overlap of a pair is counted.
OVERLAP_FRAGMENTS = 8
#: Turns with a single hub per shingle, at most, before the components that are left are compared in full.
HUB_ROUNDS = 3
#: Longs of the bitmap of a set.
BITMAP = 4
#: Stands for a null id while ids are compared; never returned.
NO_ID = 2**63 - 1

PACKED = "part int, kind int, frag int, token long, cls binary, lens binary, toks binary, hot binary, hot_n binary"
SHARED = "kind int, cls long, doc_id long, n int, token long, df long, toks binary, dfs binary"


def shingle_set(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    return np.unique(gram_hashes(hashes.of(words), width))


def _raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _packer(width: int, parts: int):
    """Documents to packed rows: kind 0 a fragment's postings, 1 a chunk of a frequent shingle, 2 members."""

    def flush(sets: dict[int, np.ndarray]) -> Iterator[dict]:
        own = np.fromiter(sets.keys(), dtype=np.uint64, count=len(sets))
        sizes = np.fromiter(map(len, sets.values()), dtype=np.int64, count=len(sets))
        toks = np.concatenate(list(sets.values()))
        who = np.repeat(np.arange(len(own)), sizes)
        uniq, back, counts = np.unique(toks, return_inverse=True, return_counts=True)
        frequent = counts >= FREQUENT
        if frequent.any():
            far = frequent[back]
            at, cls = back[far], own[who[far]]
            order = np.argsort(at, kind="stable")
            at, cls = at[order], cls[order]
            cuts = np.flatnonzero(np.diff(at)) + 1
            for k, chunk in zip(at[np.r_[0, cuts]], np.split(cls, cuts)):
                salt = xxhash.xxh3_64_intdigest(_raw(chunk[:4]) + _raw(uniq[k]))
                yield {"part": salt % parts, "kind": 1, "token": int(uniq[k].view(np.int64)), "cls": _raw(chunk)}
            toks, who = toks[~far], who[~far]
        hot, hot_n = uniq[frequent], counts[frequent]
        frag = ((toks >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        hot_frag = ((hot >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(frag.astype(np.int32), kind="stable")
        toks, who, frag = toks[order], who[order], frag[order]
        edges = np.searchsorted(frag, np.arange(parts + 1, dtype=np.uint64))
        hot_edges = np.searchsorted(hot_frag, np.arange(parts + 1, dtype=np.uint64))
        for f in range(parts):
            a, b, c, d = edges[f], edges[f + 1], hot_edges[f], hot_edges[f + 1]
            if a == b and c == d:
                continue
            w = who[a:b]
            cut = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
            lens = np.diff(np.r_[cut, len(w)]).astype(np.int32)
            yield {"part": f, "kind": 0, "frag": f, "cls": _raw(own[w[cut]]), "lens": _raw(lens), "toks": _raw(toks[a:b]), "hot": _raw(hot[c:d]), "hot_n": _raw(hot_n[c:d].astype(np.int64))}

    def members(rows: list[tuple[int, int, int]]) -> dict:
        cls, ids, ns = (np.array(x, dtype=t) for x, t in zip(zip(*rows), (np.uint64, np.int64, np.int32)))
        return {"part": xxhash.xxh3_64_intdigest(_raw(ids)) % parts, "kind": 2, "cls": _raw(cls), "toks": _raw(ids), "lens": _raw(ns)}

    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("frag", pa.int32()), ("token", pa.int64())] + [(c, pa.binary()) for c in ("cls", "lens", "toks", "hot", "hot_n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sets, rows, held = WordHashes(), {}, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = shingle_set(spaced_words(text.as_py()), hashes, width)
                cls = 0
                if len(grams):
                    cls = xxhash.xxh3_64_intdigest(_raw(grams)) or 1
                    if cls not in sets:
                        sets[cls] = grams
                        held += len(grams)
                rows.append((cls, NO_ID if doc_id is None else doc_id, len(grams)))
                if held >= FLUSH or len(rows) >= FLUSH // 8:
                    yield pa.RecordBatch.from_pylist([members(rows), *(flush(sets) if sets else ())], schema=schema)
                    sets, rows, held = {}, [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([members(rows), *(flush(sets) if sets else ())], schema=schema)

    return run


_OUT = pa.schema([("kind", pa.int32()), ("cls", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("token", pa.int64()), ("df", pa.int64()), ("toks", pa.binary()), ("dfs", pa.binary())])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of shingles that at least two classes share, with their frequency.

    Out: kind 0 a class's shared shingles of a fragment; 1 a posting of a frequent shingle, its frequency still to be
    joined; 2 members; 3 frequencies of the frequent shingles.
    """

    def out(**cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if f.name in cols else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)

    def fragment(kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]], hot: list[np.ndarray], hot_n: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cls = np.concatenate([k[0] for k in kept])
        lens = np.concatenate([k[1] for k in kept])
        toks = np.concatenate([k[2] for k in kept])
        starts = np.r_[0, np.cumsum(lens)][:-1]
        _, first = np.unique(cls, return_index=True)  # copies of a class met in other batches say nothing new
        if len(first) < len(cls):
            keep = np.zeros(len(cls), bool)
            keep[first] = True
            toks = toks[np.repeat(keep, lens)]
            cls, lens = cls[keep], lens[keep]
            starts = np.r_[0, np.cumsum(lens)][:-1]
        ht, hn = np.concatenate(hot), np.concatenate(hot_n)
        every, back = np.unique(np.r_[toks, ht], return_inverse=True)
        df = np.bincount(back[: len(toks)], minlength=len(every))
        if len(ht):
            df = df + np.bincount(back[len(toks) :], weights=hn, minlength=len(every)).astype(np.int64)
            frequent = np.unique(back[len(toks) :])
            yield out(kind=np.full(len(frequent), 3, np.int32), token=every[frequent].view(np.int64), df=df[frequent])
        mine = df[back[: len(toks)]]
        shared = mine >= 2
        if shared.any():
            n_shared = np.add.reduceat(shared.astype(np.int64), starts)
            some = n_shared > 0
            toks, mine = toks[shared], mine[shared]
            ends = np.cumsum(n_shared[some])
            begins = np.r_[0, ends[:-1]]
            raw, raw_df = _raw(toks), _raw(mine.astype(np.int64))
            yield out(kind=np.zeros(len(ends), np.int32), cls=cls[some].view(np.int64), toks=[raw[8 * a : 8 * b] for a, b in zip(begins, ends)], dfs=[raw_df[8 * a : 8 * b] for a, b in zip(begins, ends)])

    now, kept, hot, hot_n = None, [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 2:
                cls = np.frombuffer(r["cls"], np.int64)
                yield out(kind=np.full(len(cls), 2, np.int32), cls=cls, doc_id=np.frombuffer(r["toks"], np.int64), n=np.frombuffer(r["lens"], np.int32))
            elif r["kind"] == 1:
                cls = np.frombuffer(r["cls"], np.int64)
                yield out(kind=np.ones(len(cls), np.int32), cls=cls, token=np.full(len(cls), r["token"], np.int64))
            else:
                if kept and r["frag"] != now:
                    yield from fragment(kept, hot, hot_n)
                    kept, hot, hot_n = [], [], []
                now = r["frag"]
                kept.append((np.frombuffer(r["cls"], np.uint64), np.frombuffer(r["lens"], np.int32), np.frombuffer(r["toks"], np.uint64)))
                hot.append(np.frombuffer(r["hot"], np.uint64))
                hot_n.append(np.frombuffer(r["hot_n"], np.int64))
    if kept:
        yield from fragment(kept, hot, hot_n)


SURVIVOR = pa.schema([("cid", pa.int64()), ("n", pa.int32()), ("toks", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), *((f"b{k}", pa.int64()) for k in range(BITMAP))])
ALIVE = "cid long, n int, toks array<long>, prefix array<long>, " + ", ".join(f"b{k} long" for k in range(BITMAP))


def bitmap(toks: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles in each hash bucket, as longs."""
    bucket = (mixed(toks.view(np.uint64)) >> np.uint64(40)) % np.uint64(64 * BITMAP)
    odd = np.bincount(bucket.astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _survivors(num: int, den: int):
    """Rows of one class after another: keep those that can still have a link, with their prefix shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(cls_rows: list[dict]) -> dict | None:
            head = next(r for r in cls_rows if r["kind"] == 2)
            toks = [np.frombuffer(r["toks"], np.int64) for r in cls_rows if r["kind"] == 0] + [np.array([r["token"] for r in cls_rows if r["kind"] == 1], np.int64)]
            dfs = [np.frombuffer(r["dfs"], np.int64) for r in cls_rows if r["kind"] == 0] + [np.array([r["df"] for r in cls_rows if r["kind"] == 1], np.int64)]
            toks, at = np.unique(np.concatenate(toks), return_index=True)
            df = np.concatenate(dfs)[at]
            toks, df = toks[df >= 2], df[df >= 2]
            n = head["n"]
            room = n - -(-num * n // den) + 1 - (n - len(toks))
            if room <= 0:
                return None
            prefix = toks[np.lexsort((toks, df))[:room]]
            return {"cid": head["cls"], "n": n, "toks": toks, "prefix": prefix, **{f"b{k}": b for k, b in enumerate(bitmap(toks).tolist())}}

        now, rows, done = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["cls"] != now and rows:
                    done.append(close(rows))
                    rows = []
                now = r["cls"]
                rows.append(r)
            done = [x for x in done if x]
            if len(done) >= 500:
                yield pa.RecordBatch.from_pylist(done, schema=SURVIVOR)
                done = []
        if rows:
            done.append(close(rows))
        if done := [x for x in done if x]:
            yield pa.RecordBatch.from_pylist(done, schema=SURVIVOR)

    return run


def _overlapping(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link: a partial overlap per vertical fragment, then their sum."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("fragments").alias("fa"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("fragments").alias("fb"))
    partial = F.zip_with("fa", "fb", lambda x, y: F.size(F.array_intersect(x, y)))
    summed = pairs.join(left, "a").join(right, "b").select(*pairs.columns, "na", "nb", F.aggregate(partial, F.lit(0), lambda t, k: t + k).alias("k"))
    return summed.where(F.col("k") * den >= num * (F.col("na") + F.col("nb") - F.col("k"))).select(*pairs.columns)


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(members, comps): one row (cls, doc_id, n) per input row, and (cid, comp) for classes with links.

    ``cid`` is the hash of a class, as ids may be null or repeat; ``comp`` is the smallest hash reachable by links.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    packed = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_packer(width, parts), PACKED)
    dealt = packed.repartition(parts, "part").sortWithinPartitions("kind", "frag")
    shared = written(dealt.mapInArrow(_fragments, SHARED), "jaccard-shared")
    members = shared.where("kind = 2").select("cls", "doc_id", "n")
    classes = members.where("n > 0").groupBy("cls").agg(F.min("n").alias("n"))

    frequencies = shared.where("kind = 3").groupBy("token").agg(F.max("df").alias("df"))
    frequent = shared.where("kind = 1").select("cls", "token").distinct().join(frequencies, "token")
    none = lambda kind, *cols: [F.lit(kind).alias("kind"), "cls", *cols]
    rows = (
        classes.select(*none(2, "n"))
        .unionByName(shared.where("kind = 0").select(*none(0, "toks", "dfs")), allowMissingColumns=True)
        .unionByName(frequent.select(*none(1, "token", "df")), allowMissingColumns=True)
    )
    by_class = rows.repartition(parts, "cls").sortWithinPartitions("cls")
    alive = written(by_class.mapInArrow(_survivors(num, den), ALIVE), "jaccard-alive")

    fragments = F.transform(F.sequence(F.lit(0), F.lit(OVERLAP_FRAGMENTS - 1)), lambda f: F.filter("toks", lambda t: F.pmod(t, F.lit(OVERLAP_FRAGMENTS)) == f))
    sets = alive.select("cid", "n", fragments.alias("fragments"))
    bits = [f"b{k}" for k in range(BITMAP)]
    # left: how many shingles of the class stand at this one or after it in the global order
    postings = alive.select("cid", "n", F.size("toks").alias("t"), *bits, F.posexplode("prefix").alias("at", "token"))
    postings = postings.withColumn("left", F.col("t") - F.col("at")).drop("at").withColumn("comp", F.col("cid"))
    open_ = written(_several(postings), "jaccard-open")

    hub = {"cid": "hub", "n": "m", "left": "hub_left", "t": "u", "comp": "hub_comp", **{b: f"hub_{b}" for b in bits}}
    need = (F.col("n") + F.col("m")) * num
    # a shared shingle is the first one that two linked sets share only if what follows it in both can make up the overlap
    enough = (F.least("left", "hub_left") * (num + den) >= need) & (F.least("n", "m") * den >= F.greatest("n", "m") * num)
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"hub_{b}"))) for b in bits), F.lit(0))
    alike = (F.col("t") + F.col("u") - apart) * (num + den) >= need * 2
    comps, turn, going = None, 0, True
    while going and not open_.isEmpty():
        in_full = turn == HUB_ROUNDS
        if in_full:
            hubs = open_.select("token", *(F.col(c).alias(as_) for c, as_ in hub.items()))
            other = F.col("comp") < F.col("hub_comp")
        else:
            # first the class with the largest share of shared shingles, then those that the turn's hash puts first
            mark = F.struct(-F.col("t") / F.col("n"), "cid") if turn == 0 else F.struct(F.xxhash64("cid", F.lit(turn)))
            hubs = open_.groupBy("token").agg(F.min_by(F.struct(*hub), mark).alias("h"))
            hubs = hubs.select("token", *(F.col(f"h.{c}").alias(as_) for c, as_ in hub.items()))
            other = F.col("comp") != F.col("hub_comp")
        met = open_.join(hubs, "token").where(other & enough & alike)
        ordered = F.struct(F.col("cid").alias("a"), F.col("comp").alias("ca")), F.struct(F.col("hub").alias("a"), F.col("hub_comp").alias("ca"))
        pairs = met.select(F.greatest(*ordered).alias("x"), F.least(*ordered).alias("y")).select(F.col("x.a").alias("a"), F.col("x.ca").alias("ca"), F.col("y.a").alias("b"), F.col("y.ca").alias("cb")).distinct()
        found = written(_overlapping(pairs, sets, num, den).select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct(), "jaccard-links")
        if found.isEmpty():
            turn, going = HUB_ROUNDS, not in_full
            forget(found)
            continue
        moved = written(components(found), "jaccard-moved")
        comps, old = written(_renamed(comps, moved), "jaccard-comps") if comps is not None else moved, comps
        forget(found, *([moved, old] if old is not None else []))
        going, turn = not in_full, turn + 1
        if going:
            renames = comps.where("cid <> comp").select(F.col("cid").alias("__cid"), F.col("comp").alias("__comp"))
            named = open_.join(renames, F.col("cid") == F.col("__cid"), "left").withColumn("comp", F.coalesce("__comp", "comp")).drop("__cid", "__comp")
            open_, old = written(_several(named), "jaccard-open"), open_
            forget(old)
    forget(open_)
    if comps is None:
        comps = members.select(F.col("cls").alias("cid"), F.col("cls").alias("comp")).where("false")
    return members, comps.select("cid", "comp")


def _several(postings: DataFrame) -> DataFrame:
    """The postings of shingles whose classes are in several components."""
    tokens = postings.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return postings.join(tokens, "token")


def _renamed(comps: DataFrame, moved: DataFrame) -> DataFrame:
    """(cid, comp) after the components named in ``moved(cid, comp)`` have moved into others."""
    to = moved.select(F.col("cid").alias("__from"), F.col("comp").alias("__to"))
    later = comps.join(to, F.col("comp") == F.col("__from"), "left").select("cid", F.coalesce("__to", "comp").alias("comp"))
    return later.unionByName(moved.join(comps.select("cid"), "cid", "left_anti").select("cid", "comp"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``n_copies`` (rows of the same set, itself included).

    Two rows link when ``den * |A & B| >= num * |A | B|`` over their distinct ``width``-word shingles; a text with fewer
    words is one shingle. Null and empty texts have no shingles, link with nothing and keep their own id. A null id
    takes part in links; its row gets the smallest id of its component, or null. Texts that share an id, or have none, are
    separate. Repeated rows come back repeated.
    Extra columns are ignored. An empty table gives an empty result.
    """
    members, comps = linked_classes(docs, id_col, text_col, width, num, den)
    # copies of one class are many rows of one key: a count combines before the shuffle, the join back is split by AQE
    classes = members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    linked = classes.join(comps, F.col("cls") == F.col("cid"))
    names = linked.groupBy("comp").agg(F.min("least").alias("name"))
    renamed = linked.join(names, "comp").select("cls", "name")
    named = classes.join(renamed, "cls", "left").select("cls", F.coalesce("name", "least").alias("component_id"), "n_copies")
    whole = members.join(named, "cls", "left")
    empty = F.col("n") == 0
    return whole.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(~empty, F.expr(f"nullif(component_id, {NO_ID})")).otherwise(F.expr(f"nullif(doc_id, {NO_ID})")).alias("component_id"),
        F.when(empty, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay when one of each component does: the rows whose id names the component.

    Rows with a null id and rows without shingles all stay, as nothing names a group for them. Repeated rows of the
    naming id come back repeated.
    """
    found = jaccard_components(docs, id_col, text_col)
    stays = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__stay")).distinct()
    words = F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", "")) > 0
    matched = docs.join(stays, docs[id_col] == F.col("__stay"), "left")
    return matched.where(F.col("__stay").isNotNull() | docs[id_col].isNull() | ~words).drop("__stay")
