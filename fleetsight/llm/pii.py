"""Personal data: fixed patterns, and a conditional random field over word shapes for the forms that they miss.

The field is trained on a small labelled table and decoded by Viterbi over batches. It reads every text whole, but for
texts without a digit and without an address's host, as no span of theirs could count. A span that it finds counts if it
could be of its kind (digits in number and check sum, an address with host) and touches no span of the patterns, which
always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetsight.llm.crf import Chain, trained

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Check sum of a card number."""
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: leftmost matches per kind that pass their check."""
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        # long parts stay text: Python refuses to convert thousands of digits, leading zeros included
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


# fixed values: the labelled table, spans in braces as {kind|text}
LABELLED = (
    "call me at {phone|(068) 555-2212} after nine",
    "phone {phone|555-867-5309} or write",
    "my number is {phone|030 5557 2210} if you need it",
    "Tel. {phone|0049 30 555 2210}, room 12",
    "tel: {phone|(212) 555-0199} ext 4",
    "ring {phone|020 7946 0958} before 5 pm",
    "fax {phone|01 42 68 53 00} and the letter",
    "mobile {phone|07700 900123} is best",
    "phone: {phone|555.123.4567} (office)",
    "reach us on {phone|1-800-555-0142} any day",
    "telephone {phone|089 5550 1234} from 9 to 17",
    "write to {email|anna at mail.example.com} today",
    "mail {email|jo.smith (at) example.org} please",
    "email {email|kim [at] blog.example.net} for more",
    "contact {email|info at shop.example.com} or visit",
    "server {ip|10 . 0 . 0 . 1} is down",
    "from {ip|192.168.0 .17} on port 80",
    "host {ip|172 .16.4.9} answered in 20 ms",
    "card {card|4111 1111/1111 1111} was charged",
    "card no. {card|4012.8888.8888.1881} valid to 12/29",
    "visa {card|4222_2222_2222_2228} on file",
    "paid with {card|5555/5555/5555/4444} last week",
    "version 2.0 of the file has 300 lines",
    "in 1999 there were 12 of them and 2004 had 31",
    "the years 1990-1995 and pages 120-134",
    "released under version 3.0 on 2024-05-01",
    "at 10:30 and 14:45 on 12/03/2021",
    "order 20210345 ships in 3 boxes of 12",
    "the total was 1,204,300.50 or 12.5 percent",
    "chapter 4 section 12.3.1 table 7",
    "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962 in the file",
    "key b44e15e09fd311c3cf3163b66d5a9875b883d8ce expires",
    "id 2852466340876421 in row 17",
    "number 7931824386410944 of the list",
    "meet at the station at 8 or at noon",
    "look at page 3 and at figure 12",
    "see http://www.example.com/a/2024/05 for 3 more",
    "width 800 height 600 depth 24",
    "a 5 b 17 c 29 d 41 e 53",
    "isbn 978-3-16-148410-0 and price 12.99",
    "temperatures of 21.5 and 22.0 at 3 places",
    "room 101 floor 3 building 7",
    "it was 3 to 2 at half time and 5 to 4 at the end",
    "ref 555-12 and part 0199",
    "the 2nd of 4 and the 3rd of 9",
    "lines 10 20 30 40 50 60 70 80",
    "code 12345 or 54321 at the door",
    "population 83 200 000 in 2020",
)
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
# fixed values: words that go with personal data
HINTS = {"tel", "telephone", "phone", "mobile", "call", "ring", "fax", "mail", "email", "contact", "write", "card", "visa", "paid", "ip", "server", "host", "from", "at", "dot", "com", "net", "org", "number", "no"}


def shape(word: str) -> str:
    """Digits by number, letters by case, anything else as it is."""
    if word[0].isdigit():
        return f"d{min(len(word), 9)}"
    if word.isalpha():
        return "x" if word.islower() else "X" if word.isupper() else "Xx"
    return word


def features(words: list[str], glued: list[bool]) -> list[tuple[str, ...]]:
    """Shapes of a token and its neighbours, hint words, and whether white space stands before it."""
    shapes = ["^", *(shape(w) for w in words), "$"]
    hints = ["", *(w.lower() if w.lower() in HINTS else "" for w in words), ""]
    near = [""] * len(words)
    seen = ""
    for k, w in enumerate(words):  # the last hint word that only marks, digits and joined words have followed
        near[k] = seen
        if w.isalpha():
            seen = hints[k + 1] or (seen if glued[k] else "")
    return [(shapes[k + 1], shapes[k] + glued[k] * "+", shapes[k + 2], shapes[k] + "|" + shapes[k + 1] + "|" + shapes[k + 2], hints[k + 1], near[k], str(glued[k])) for k in range(len(words))]


def tokenised(text: str) -> tuple[list[str], list[bool], list[tuple[int, int]]]:
    spans = [m.span() for m in TOKEN.finditer(text)]
    return [text[a:b] for a, b in spans], [k > 0 and spans[k - 1][1] == a for k, (a, _) in enumerate(spans)], spans


def labelled_rows(lines: tuple[str, ...]) -> list[tuple[list[tuple[str, ...]], list[str]]]:
    out = []
    for line in lines:
        plain, marks = "", []
        for part in re.split(r"(\{[^}]*\})", line):
            if part.startswith("{"):
                kind, _, inner = part[1:-1].partition("|")
                marks.append((kind, len(plain), len(plain) + len(inner)))
                plain += inner
            else:
                plain += part
        words, glued, spans = tokenised(plain)
        ys = ["O"] * len(words)
        for kind, a, b in marks:
            inside = [k for k, (s, e) in enumerate(spans) if a <= s and e <= b]
            for k in inside:
                ys[k] = ("B-" if k == inside[0] else "I-") + kind
        out.append((features(words, glued), ys))
    return out


def _allowed(a: str, b: str) -> bool:
    return not b.startswith("I-") or a[2:] == b[2:]


@lru_cache(maxsize=4)
def model(lines: tuple[str, ...] = LABELLED) -> Chain:
    """The field of a labelled table; training is deterministic."""
    return trained(labelled_rows(lines), allowed=_allowed)


class Coder:
    """``chain.rows(features(...))`` of whole texts by table lookups: words, shapes and hints are numbered once."""

    #: Words held with their numbers.
    HELD = 200_000

    def __init__(self, chain: Chain):
        shapes, values = sorted({"^", "$", *chain.values[0]}), chain.values
        size = len(shapes) + 1  # number 0 is any shape that training has not seen
        self.shape = {s: k + 1 for k, s in enumerate(shapes)}
        self.hint = {h: k + 1 for k, h in enumerate(sorted(HINTS))}
        self.own, self.after = (np.array([0, *(values[f].get(s, 0) for s in shapes)], np.int16) for f in (0, 2))
        self.before = np.array([[0, 0], *([values[1].get(s + g * "+", 0) for g in (0, 1)] for s in shapes)], np.int16)
        self.three = np.zeros((size, size, size), np.int16)
        for i, x in enumerate(shapes):
            for j, y in enumerate(shapes):
                self.three[i + 1, j + 1, 1:] = [values[3].get(f"{x}|{y}|{z}", 0) for z in shapes]
        self.marks, self.near = (np.array([values[f].get(h, 0) for h in ("", *sorted(HINTS))], np.int16) for f in (4, 5))
        self.joined = np.array([values[6].get(str(g), 0) for g in (False, True)], np.int16)
        self.words: dict[str, int] = {}

    def _number(self, word: str) -> int:
        """Shape, hint and whether the word is letters, in one number."""
        if len(self.words) >= self.HELD:
            self.words.clear()
        number = self.shape.get(shape(word), 0) << 8 | self.hint.get(word.lower(), 0) << 1 | word.isalpha()
        self.words[word] = number
        return number

    def rows(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature rows, starts, ends) of the tokens of a text."""
        words, held = TOKEN.findall(text), self.words
        n = len(words)
        starts = np.fromiter((m.start() for m in TOKEN.finditer(text)), np.int64, n)
        ends = starts + np.fromiter(map(len, words), np.int64, n)
        codes = np.fromiter((held[w] if w in held else self._number(w) for w in words), np.int64, n)
        glued = np.r_[False, starts[1:] == ends[:-1]][:n].astype(np.int64)
        shapes = np.r_[self.shape["^"], codes >> 8, self.shape["$"]]
        hints = codes >> 1 & 127
        # the last word that sets or ends a hint: letters with one, or letters not joined to what stands before
        sets = (codes & 1 > 0) & ((hints > 0) | (glued == 0))
        last = np.maximum.accumulate(np.r_[-1, np.where(sets, np.arange(n), -1)])[:n]
        seen = np.where(last < 0, 0, hints[last]) if n else hints
        before, own, after = shapes[:-2], shapes[1:-1], shapes[2:]
        rows = (self.own[own], self.before[before, glued], self.after[after], self.three[before, own, after], self.marks[hints], self.near[seen], self.joined[glued])
        return np.stack(rows, axis=1), starts, ends


_DOTTED = re.compile(r"[A-Za-z0-9-]\.[A-Za-z]{2}")
_AT = re.compile(r"@|\bat\b", re.I)


def readable(text: str) -> bool:
    """Whether any span of the text could be ``plausible``: all need a digit, or a dotted host and a sign or word 'at'."""
    return bool(_DIGIT.search(text) or _DOTTED.search(text) and _AT.search(text))


def plausible(kind: str, found: str) -> bool:
    """Whether a span of the field could be of its kind."""
    digits = "".join(c for c in found if c.isascii() and c.isdigit())
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return bool(re.search(r"[A-Za-z0-9-]+\.[A-Za-z]{2,}", found)) and ("@" in found or re.search(r"\bat\b", found, re.I) is not None)


def field_spans(texts: list[str], base: list[list[Span]], chain: Chain, coder: Coder | None = None) -> list[list[Span]]:
    """Spans of the field in a batch of texts, those that touch no base span and could be of their kind."""
    coder = coder or Coder(chain)
    read = [k for k, text in enumerate(texts) if readable(text)]
    coded = [coder.rows(texts[k]) for k in read]
    out: list[list[Span]] = [[] for _ in texts]
    outside = chain.labels.index("O")
    for k, (_, starts, ends), path in zip(read, coded, chain.viterbi([rows for rows, _, _ in coded])):
        done = 0
        for first in np.flatnonzero(path != outside).tolist():
            if first < done:
                continue
            kind, done = chain.labels[path[first]][2:], first + 1
            while done < len(path) and chain.labels[path[done]] == f"I-{kind}":
                done += 1
            s, e = int(starts[first]), int(ends[done - 1])
            if plausible(kind, texts[k][s:e]) and all(e <= x or y <= s for _, x, y in base[k]):
                out[k].append((kind, s, e))
    return out


def joined(spans: list[Span]) -> str:
    """kind:start:end by kind, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the union by its first kind."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


#: Texts, and bytes of them, decoded together; a longer text is decoded alone.
BATCH = 2_000
BATCH_BYTES = 4_000_000


def _cuts(texts: pa.Array) -> list[tuple[int, int]]:
    """(first row, rows) of the batches of a column."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    out, first, held = [], 0, 0
    for k, size in enumerate(sizes):
        if k > first and (k - first >= BATCH or held + size > BATCH_BYTES):
            out.append((first, k - first))
            first, held = k, 0
        held += size
    return [*out, (first, len(sizes) - first)] if sizes else out


def _finder(chain: Chain, schema: pa.Schema, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(chain)
        for whole in batches:
            for at, n in _cuts(whole.column(whole.num_columns - 1)):
                batch = whole.slice(at, n)
                raw = batch.column(batch.num_columns - 1).to_pylist()
                texts = [t or "" for t in raw]
                base = [base_spans(t) for t in texts]
                more = field_spans(texts, base, chain, coder)
                cols = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                cols += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(b + m) for b, m in zip(base, more)])]
                if redact:
                    cols.append(pa.array([t if t is None else redacted(t, b + m) for t, b, m in zip(raw, base, more)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], schema=schema)

    return run


def find(docs: DataFrame, keep: list[str], text_col: str = "text", lines: tuple[str, ...] = LABELLED, redact: bool = False) -> DataFrame:
    """The columns ``keep``, counts of the patterns' spans by kind, their digest, and all ``spans`` in code points.

    ``redact`` adds the text with spans replaced as ``redacted``. One row per input row, repeated rows included. Null and
    empty texts have no spans; a null text stays null when redacted. Extra columns are ignored; kept ones may have any
    name but those returned.
    """
    mine = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    out = T.StructType([*mine.schema.fields[:-1], *FOUND, *([T.StructField("redacted", T.StringType())] if redact else [])])
    return mine.mapInArrow(_finder(model(lines), to_arrow_schema(out), redact), out)


def redact(docs: DataFrame, text_col: str = "text", lines: tuple[str, ...] = LABELLED) -> DataFrame:
    """``docs`` with its texts redacted; all rows and other columns as they are."""
    names = [f"__c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    found = find(docs.toDF(*names), [n for k, n in enumerate(names) if k != at], text_col=names[at], lines=lines, redact=True)
    return found.select(*(F.col("redacted" if k == at else n).alias(c) for k, (n, c) in enumerate(zip(names, docs.columns))))
