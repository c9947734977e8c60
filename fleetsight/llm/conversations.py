"""Repair of the role structure of conversations by the cheapest audit, the first in ASCII order among equally cheap ones.

Rows are sorted once over the whole table by ranges (conversation, turn, ...), so a conversation of any size is spread over
tasks, and cut into buckets of rows. In a bucket a dynamic program walks the rows and keeps, per state of the role grammar,
the best audit so far. Audits are linked nodes that share their prefixes; each node knows its ancestors at distances of
powers of two and a rolling hash of its whole text, so a tie is settled by a binary search for the longest common
prefix; equal hashes are verified node by node. Where a conversation spans buckets, each bucket has the best audit from
every state to every state, and a fold over the buckets picks the path. A last pass applies the audits to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fleetsight.llm.stage import shuffle_partitions, written

#: Rows of a bucket: 2 to this power.
BUCKET_BITS = 12
#: Characters of a text that take part in the choice of ranges; equal starts stay in one range.
RANGE_CHARS = 32
#: Costs of the edits. An insert has to cost something: then no audit ties with a longer one that begins with it.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a kept row of that role initial, where the grammar (s?(ua)+)? allows it.
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state after the user or assistant row that may follow.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

MODULUS, BASE = (1 << 61) - 1, 911_382_323


class Audit:
    """A text of edits as a node behind the node of its prefix."""

    __slots__ = ("text", "mark", "up", "count", "length", "hash")

    def __init__(self, before: Audit | None, text: str, mark: tuple | None = None):
        self.text, self.mark = text, mark
        if before is None:
            self.up, self.count, self.length, self.hash = (), 0, 0, 0
            return
        self.count, self.length, self.hash = before.count + 1, before.length + len(text), before.hash
        for c in text:
            self.hash = (self.hash * BASE + ord(c)) % MODULUS
        up = [before]
        while len(up[-1].up) >= len(up):
            up.append(up[-1].up[len(up) - 1])
        self.up = tuple(up)

    def at(self, count: int) -> Audit:
        """The ancestor of so many nodes."""
        node, over = self, self.count - count
        while over:
            k = over.bit_length() - 1
            node, over = node.up[k], over - (1 << k)
        return node

    def chain(self, above: int = 0) -> list[Audit]:
        """The nodes beyond the first ``above``, in order."""
        nodes, node = [], self
        while node.count > above:
            nodes.append(node)
            node = node.up[0]
        return nodes[::-1]

    def rest(self, above: int = 0) -> str:
        return "".join(n.text for n in self.chain(above))


def _verified(a: Audit, b: Audit) -> bool:
    """Whether nodes of equal hash have equal texts. What has been verified once is shared from then on."""
    pairs = []
    while a is not b:
        if a.text != b.text:
            return False
        pairs.append((a, b))
        a, b = a.up[0], b.up[0]
    for x, y in pairs:
        y.up = x.up
    return True


def before(a: Audit, b: Audit) -> bool:
    """Whether the text of ``a`` comes before that of ``b``."""
    low = min(a.count, b.count)
    x, y = a.at(low), b.at(low)
    same = lambda p, q: p is q or (p.hash == q.hash and p.length == q.length)
    if not same(x, y):
        for k in range(len(x.up) - 1, -1, -1):
            if k < len(x.up) and not same(x.up[k], y.up[k]):
                x, y = x.up[k], y.up[k]
        x, y = x.up[0], y.up[0]
    above = x.count if _verified(x, y) else 0  # else hashes of different texts met
    if above < low:
        p, q = a.at(above + 1).text, b.at(above + 1).text
        if not (p.startswith(q) or q.startswith(p)):
            return p < q
    return a.rest(above) < b.rest(above)


Paths = dict[int, tuple[int, Audit]]


def _offer(paths: Paths, state: int, cost: int, prefix: Audit, text: str, mark: tuple | None = None) -> bool:
    held = paths.get(state)
    if held is not None and held[0] < cost:
        return False
    node = Audit(prefix, text, mark)
    if held is None or cost < held[0] or before(node, held[1]):
        paths[state] = (cost, node)
        return True
    return False


def with_inserts(paths: Paths) -> Paths:
    """What any number of inserted rows reach too."""
    paths, moved = dict(paths), True
    while moved:
        moved = False
        for state in sorted(paths, key=lambda s: paths[s][0]):
            cost, node = paths[state]
            moved |= _offer(paths, NEXT[state], cost + INSERT, node, "I")
    return paths


def after_row(paths: Paths, initial: str, gone: bool, truncated: bool) -> Paths:
    """The best audits with one row more; ``gone``: the row has to be deleted."""
    new: Paths = {}
    extra = TRUNCATED * truncated
    for state, (cost, node) in with_inserts(paths).items():
        _offer(new, state, cost + DELETE, node, "D")
        if not gone:
            kept = KEEPS[state].get(initial)
            if kept is not None:
                _offer(new, kept, cost + extra, node, "K")
            _offer(new, NEXT[state], cost + REROLE + extra, node, "R")
    return new


def best(paths: Paths) -> tuple[int, Audit]:
    """The cheapest audit that ends in a whole conversation."""
    paths = with_inserts(paths)
    ends = [paths[s] for s in (START, ASSISTANT) if s in paths]
    if len(ends) == 2 and (ends[1][0] < ends[0][0] or (ends[1][0] == ends[0][0] and before(ends[1][1], ends[0][1]))):
        return ends[1]
    return ends[0]


def _piece_fields(conv: pa.DataType) -> pa.Schema:
    whole = ("n", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")
    path = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    return pa.schema([("conv", conv), ("rid", pa.int64()), *((c, pa.int64()) for c in whole), ("head", pa.string()), ("tail", pa.string()), ("paths", pa.list_(path))])


PIECE = "rid long, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, head string, tail string, paths array<struct<start:int,end:int,cost:bigint,audit:string>>"


def _pieces(schema: pa.Schema):
    """Rows of a bucket after another, in order, to one row per conversation and bucket."""

    def closed(rows: list[tuple], first: bool) -> dict:
        out = {"conv": rows[0][0], "rid": rows[0][1], "n": len(rows), "head": rows[0][3], "tail": rows[-1][3]}
        turns = [r[2] for r in rows if r[2] is not None]
        out |= {"turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None}
        out |= {"blank": sum(r[4] for r in rows), "duplicate": sum(r[5] and not r[4] for r in rows), "truncated": sum(r[6] and not r[4] and not r[5] for r in rows)}
        out["illegal"] = sum(p[3] + q[3] not in LEGAL for p, q in zip(rows, rows[1:]))
        found = []
        for start in range(4) if first else (START,):  # only the first of a bucket may have begun in another
            paths: Paths = {start: (0, Audit(None, ""))}
            for _, _, _, initial, blank, duplicate, truncated in rows:
                paths = after_row(paths, initial, blank or duplicate, truncated)
            found += [{"start": start, "end": end, "cost": cost, "audit": node.rest()} for end, (cost, node) in paths.items()]
        return out | {"paths": found}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        bucket, first = None, True
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                at = row[1] >> BUCKET_BITS
                if rows and (at != bucket or row[0] != rows[0][0]):
                    made.append(closed(rows, first))
                    rows, first = [], False
                if at != bucket:
                    bucket, first = at, True
                rows.append(row)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
        if rows:
            yield pa.RecordBatch.from_pylist([closed(rows, first)], schema=schema)

    return run


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conversation, its rows) of rows sorted by conversation; the rows of one have to be read before the next."""
    rows = (r for batch in batches for r in batch.to_pylist())
    ahead = next(rows, None)

    while ahead is not None:
        conv, done = ahead["conv"], False

        def own() -> Iterator[dict]:
            nonlocal ahead, done
            while ahead is not None and ahead["conv"] == conv:
                now, ahead = ahead, next(rows, None)
                yield now
            done = True

        yield conv, own()
        if not done:
            raise RuntimeError("rows of a conversation were left")


STEP = pa.struct([("rid", pa.int64()), ("n", pa.int64()), ("start", pa.int32()), ("audit", pa.string())])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _fold(schema: pa.Schema):
    """Pieces of one conversation after another, in order, to one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for conv, pieces in _runs(batches):
            out = dict.fromkeys(COUNTS, 0)
            paths: Paths = {START: (0, Audit(None, ""))}
            tail, lowest, highest, turns = None, None, None, 0
            for p in pieces:
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    out[c] += p[c]
                out["illegal"] += tail is not None and tail + p["head"] not in LEGAL
                tail = p["tail"]
                if p["first_turn"] is not None:
                    turns += p["turns"] - (p["first_turn"] == highest)
                    lowest, highest = p["first_turn"] if lowest is None else lowest, p["last_turn"]
                new: Paths = {}
                for path in p["paths"]:
                    if path["start"] in paths:
                        cost, node = paths[path["start"]]
                        _offer(new, path["end"], cost + path["cost"], node, path["audit"], (p["rid"], p["n"], path["start"]))
                paths = new
            out["gaps"] = highest - lowest + 1 - turns if turns else 0
            out["cost"], node = best(paths)
            steps: list[dict] = []
            for x in node.chain():
                if x.mark is None:
                    steps[-1]["audit"] += x.text
                else:
                    steps.append({"rid": x.mark[0], "n": x.mark[1], "start": x.mark[2], "audit": x.text})
            made.append({"conv": conv, **out, "audit": node.rest(), "steps": steps})
            if len(made) >= 500:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return run


def _repaired(rows: Iterator[dict]) -> Iterator[tuple[str, str, str, int | None]]:
    """(edit, role, text, turn) of the rows that stay or are put in; each step of the audit comes before its rows."""
    audit, at, state, left = "", 0, START, 0

    def put_in() -> Iterator[tuple[str, str, str, None]]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, NEXT[state]
            yield "I", ROLE[state], "", None

    for r in rows:
        if r["kind"] == 0:
            audit, at, state, left = r["audit"], 0, r["start"], r["n"]
            continue
        yield from put_in()
        edit = audit[at]
        at, left = at + 1, left - 1
        if edit != "D":
            state = NEXT[state] if edit == "R" else KEEPS[state][r["role"][:1]]
            yield edit, ROLE[state] if edit == "R" else r["role"], r["text"], r["turn"]
        if left == 0:
            yield from put_in()


def _apply(schema: pa.Schema, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for conv, rows in _runs(batches):
            digest = hashlib.sha256()
            for k, (edit, role, text, turn) in enumerate(_repaired(rows)):
                if digests:
                    digest.update(f"\n{role}:{text}".encode()[0 if k else 1 :])
                    continue
                made.append({"conv": conv, "position": k, "turn": turn, "role": role, "text": text, "edit": edit})
                size += len(text) + 100
                if size >= 4_000_000:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made, size = [], 0
            if digests:
                made.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return run


BLANK = "[^\\x20\\x09-\\x0D]"
#: The last character that is not blank ends a sentence.
ENDED = "[.!?][\\x20\\x09-\\x0D]*\\z"


class Repair:
    """The repair of a table of conversations: ``audits`` has a row per conversation, ``rows()`` the repaired rows."""

    def __init__(self, rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        """Null roles and texts are read as one space. Rows go by turn, null turns first, then by role and text.

        A null conversation id is a conversation of its own; ids may have any type that can be sorted. Repeated rows are
        rows of their own, and duplicates. Extra columns are ignored. An empty table has no audits.
        """
        spark = rows.sparkSession
        self.id_col, self.kind, self.parts = id_col, rows.schema[id_col].dataType, shuffle_partitions(spark)
        named = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
        order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role")]
        dealt = named.repartitionByRange(self.parts, *order, F.left("text", F.lit(RANGE_CHARS))).sortWithinPartitions(*order, "text")
        flagged = dealt.select("*", (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("truncated"), F.unhex(F.sha2("text", 256)).alias("key"))
        # ids grow with the order of the rows: by range, then by place in it
        self.sorted = written(flagged.withColumn("rid", F.monotonically_increasing_id()), "conversation-rows")
        self.audits_full = written(self._audits(), "conversation-audits")

    def _audits(self) -> DataFrame:
        rows = self.sorted.select("conv", "rid", "turn", "role", "blank", "truncated", "key")
        # the first of equal rows combines before the shuffle; blank rows are a fault of their own and stay out of it
        firsts = rows.where(~F.col("blank")).groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min("rid").alias("first"))
        met = rows.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k")) & ~F.col("blank"), "left")
        light = met.select("conv", "rid", "turn", F.left("role", F.lit(1)).alias("initial"), "blank", F.coalesce(F.col("rid") > F.col("first"), F.lit(False)).alias("duplicate"), "truncated")
        conv, arrow = self.kind.simpleString(), to_arrow_type(self.kind)
        buckets = light.repartition(self.parts, F.shiftright("rid", BUCKET_BITS)).sortWithinPartitions("rid")
        pieces = buckets.mapInArrow(_pieces(_piece_fields(arrow)), f"conv {conv}, {PIECE}")
        schema = pa.schema([("conv", arrow), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("steps", pa.list_(STEP))])
        ddl = f"conv {conv}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, steps array<struct<rid:bigint,n:bigint,start:int,audit:string>>"
        return pieces.repartition(self.parts, "conv").sortWithinPartitions("conv", "rid").mapInArrow(_fold(schema), ddl)

    @property
    def audits(self) -> DataFrame:
        """Per conversation with rows: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``."""
        return self.audits_full.select(F.col("conv").alias(self.id_col), *COUNTS, "audit")

    def _edited(self) -> DataFrame:
        steps = self.audits_full.select("conv", F.inline("steps")).withColumn("kind", F.lit(0))
        rows = self.sorted.select("conv", "rid", "turn", "role", "text").withColumn("kind", F.lit(1))
        both = rows.unionByName(steps, allowMissingColumns=True)
        return both.repartition(self.parts, "conv").sortWithinPartitions("conv", "rid", "kind")

    def _applied(self, digests: bool, fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
        schema = pa.schema([("conv", to_arrow_type(self.kind)), *fields])
        return self._edited().mapInArrow(_apply(schema, digests), f"conv {self.kind.simpleString()}, {ddl}").withColumnRenamed("conv", self.id_col)

    def rows(self) -> DataFrame:
        """The repaired rows: id, ``position`` from 0, ``turn`` (null where put in), ``role``, ``text``, ``edit``."""
        fields = [("position", pa.int64()), ("turn", pa.int64()), *((c, pa.string()) for c in ("role", "text", "edit"))]
        return self._applied(False, fields, "position long, turn long, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """Per conversation the SHA-256 of its repaired rows as ``role:text``, joined by line breaks.

        The hash runs over the rows in order, so a conversation's texts stream through one task; none is held.
        """
        return self._applied(True, [("repaired_sha256", pa.string())], "repaired_sha256 string")


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with the faults that CRC-32 of ``id:turn`` modulo 20 names: 0 drops the row, 1 empties the text, 2 takes its
    sentence ends, 3 repeats the row, 4 makes the role user. Nulls are written as one space in that key, in roles and in texts."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    role = F.when(fault == 4, "user").otherwise(space(role_col))
    times = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    return conversations.where(fault != 0).select(id_col, turn_col, role.alias(role_col), text.alias(text_col), times.alias("__copy")).drop("__copy")


def repaired_conversations(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Damage, then repair: one row per original conversation with counts, audit and the digest of its repaired rows.

    A conversation without rows after the damage has zeros, an empty audit and the digest of the empty text.
    """
    repair = Repair(damaged(conversations, id_col), id_col)
    known = conversations.select(id_col).distinct()
    for found in (repair.audits, repair.digests()):
        named = found.withColumnRenamed(id_col, "__conv")
        known = known.join(named, known[id_col].eqNullSafe(named["__conv"]), "left").drop("__conv")
    none = hashlib.sha256(b"").hexdigest()
    return known.select(id_col, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS[:5]), F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
