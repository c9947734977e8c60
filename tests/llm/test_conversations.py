"""Conversation repair against a brute-force search over all audits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from fleetsight.llm import conversations
from fleetsight.llm.conversations import Audit, Repair, damaged, repaired_conversations
from fleetsight.llm.queries import op13_conversation_repair

SMALL = "/root/testdata/sf0.001"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute_audit(rows):
    """Cheapest audits by Dijkstra-like search over (row, state) with whole strings."""
    best = {(0, "0"): (0, "")}
    queue = [(0, "", 0, "0")]
    import heapq

    done = set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(rows) and state in "0a":
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        follow = "a" if state == "u" else "u"
        steps = [(5, "I", i, follow)]
        if i < len(rows):
            initial, gone, cut = rows[i]
            steps.append((2, "D", i + 1, state))
            if not gone:
                if initial == follow or (initial == "s" and state == "0"):
                    steps.append((5 * cut, "K", i + 1, initial))
                steps.append((1 + 5 * cut, "R", i + 1, follow))
        for c, e, j, s in steps:
            heapq.heappush(queue, (cost + c, audit + e, j, s))
    return best


def brute(conv_rows):
    rows = sorted(conv_rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    cost, audit = brute_audit([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
    out, k, state = [], 0, "0"
    for e in audit:
        follow = "a" if state == "u" else "u"
        if e == "I":
            state = follow
            out.append({"u": "user", "a": "assistant"}[state] + ":")
            continue
        _, _, role, text = rows[k]
        k += 1
        if e == "K":
            state = role[0]
            out.append(f"{role}:{text}")
        elif e == "R":
            state = follow
            out.append({"u": "user", "a": "assistant"}[state] + f":{text}")
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_all(rows):
    after = brute_damage(rows)
    return {c: brute([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def made_rows(rng, n, longest):
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sage"])
            text = rng.choice(["Yes.", "no", "", " \t", None, "What?", "A long one that ends.", "é!\n", f"t{turn}.", f"t{turn}"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def results(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r[0]: tuple(r)[1:] for r in repaired_conversations(df).collect()}


def test_repair_equals_brute_force(spark):
    rows = made_rows(random.Random(3), 150, 14)
    assert results(spark, rows) == brute_all(rows)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 3])
def test_audits_over_many_buckets_and_with_colliding_hashes(spark, monkeypatch, modulus):
    """Buckets of two rows, and hashes that hardly tell texts apart."""
    rng = random.Random(4)
    rows = [("s" if k == 0 and rng.random() < 0.5 else rng.choice("uuaatx"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(200) for k in range(1)]
    monkeypatch.setattr(conversations, "MODULUS", modulus)
    for n in (0, 1, 2, 3, 7, 20, 60):
        for _ in range(12):
            some = [rng.choice(rows) for _ in range(n)]
            paths = {0: (0, Audit(None, ""))}
            for initial, gone, cut in some:
                paths = conversations.after_row(paths, initial, gone, cut)
            cost, node = conversations.best(paths)
            assert (cost, node.rest()) == brute_audit(some)


def test_a_conversation_over_many_buckets(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(conversations, "BUCKET_BITS", 2)
    rng = random.Random(6)
    light = []
    for conv, n in ((1, 3), (2, 90), (3, 1), (4, 17), (5, 4)):
        for k in range(n):
            light.append((conv, len(light) + 5, None if k == 0 else k // 2 * 3, rng.choice("usaat"), rng.random() < 0.1, rng.random() < 0.1, rng.random() < 0.3))
    names = ["conv", "rid", "turn", "initial", "blank", "duplicate", "truncated"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*light)], names)
    fields = conversations._piece_fields(pa.int64())
    pieces = [b for k in range(0, len(light), 7) for b in [batch.slice(k, 7)]]
    pieces = list(conversations._pieces(fields)(iter(pieces)))
    assert sum(b.num_rows for b in pieces) > 30
    schema = pa.schema([("conv", pa.int64()), *((c, pa.int64()) for c in conversations.COUNTS), ("audit", pa.string()), ("steps", pa.list_(conversations.STEP))])
    folded = {r["conv"]: r for b in conversations._fold(schema)(iter(pieces)) for r in b.to_pylist()}
    for conv in range(1, 6):
        rows = [r for r in light if r[0] == conv]
        cost, audit = brute_audit([(r[3], r[4] or r[5], r[6] and not r[4] and not r[5]) for r in rows])
        got = folded[conv]
        assert (got["cost"], got["audit"]) == (cost, audit) and "".join(s["audit"] for s in got["steps"]) == audit
        turns = {r[2] for r in rows if r[2] is not None}
        assert got["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert got["illegal"] == sum(a[3] + b[3] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))


def test_ties_are_ascii_least():
    for n in range(5):
        for some in product([("u", False, False), ("a", False, True), ("s", False, False), ("t", True, False)], repeat=n):
            paths = {0: (0, Audit(None, ""))}
            for row in some:
                paths = conversations.after_row(paths, *row)
            cost, node = conversations.best(paths)
            assert (cost, node.rest()) == brute_audit(list(some))


def test_order_of_audits_with_other_segments():
    root = Audit(None, "")
    a = Audit(Audit(root, "KK"), "RD")
    b = Audit(Audit(root, "KKR"), "DK")
    c = Audit(Audit(root, "KKR"), "D")
    for x, y in ((a, b), (b, a), (a, c), (c, a), (b, c), (c, b)):
        assert conversations.before(x, y) == (x.rest() < y.rest())
    deep = root
    for k in range(300):
        deep = Audit(deep, "KD"[k % 2])
    assert deep.at(7).rest() == deep.rest()[:7] and len(deep.rest()) == deep.length == 300


def test_repaired_rows_and_awkward_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again?"), (1, 2, "assistant", "Yes."), (2, None, None, None), (3, 5, "system", "Be kind."), (3, 6, "user", "Q?"), (3, 9, "assistant", "A. " * 30_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as conv", "1 as rid", "2 as kind", "'k' as key", "0 as cost")
    repair = Repair(df)
    got = {}
    for r in sorted(repair.rows().collect(), key=lambda r: (r.conv_id, r.position)):
        got.setdefault(r.conv_id, []).append((r.role, r.text, r.edit, r.turn))
    assert got == {1: [("user", "Again?", "K", 1), ("assistant", "Yes.", "K", 2)], 3: [("system", "Be kind.", "K", 5), ("user", "Q?", "K", 6), ("assistant", "A. " * 30_000, "K", 9)]}
    audits = {r.conv_id: r for r in repair.audits.collect()}
    assert audits[1].audit == "DKK" and audits[2].blank == 1 and audits[2].audit == "D" and audits[3].gaps == 2
    empty = df.where("false")
    assert Repair(empty).rows().count() == 0 and repaired_conversations(empty).count() == 0
    text_ids = repaired_conversations(df.withColumn("conv_id", df.conv_id.cast("string")))
    assert {r.conv_id for r in text_ids.collect()} == {"1", "2", "3"}


def test_conversations_that_lose_all_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert results(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).count() == 0


def test_query_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in op13_conversation_repair(spark, SMALL).collect()} == brute_all(rows)
