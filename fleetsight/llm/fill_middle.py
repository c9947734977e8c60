"""Fill-in-middle transformation of texts, as a pyarrow.compute pipeline over Arrow batches.

Texts are split into lines, the list array is flattened with parent indices, each unit gets its ordinal in its text and
from that a role (prefix, middle, suffix), each role's units become a list array again and are joined. Where a text is
cut and which form it takes follows from a hash of its id, so a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that go through the pipeline at a time; one text at least.
SLICE_BYTES = 8 << 20


class Marks(NamedTuple):
    """What stands before the prefix, the suffix and the middle. No mark may begin as it ends, else a text before it could move it."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def checked(self) -> Marks:
        if any(not m or any(m.startswith(m[k:]) for k in range(1, len(m))) for m in self) or len(set(self)) < 3:
            raise ValueError(f"marks have to be three different texts that do not begin as they end: {tuple(self)}")
        return self


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_BYTES."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = np.flatnonzero(np.diff(held // SLICE_BYTES)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(held)]):
        if b > a:
            yield batch.slice(a, b - a)


def units(text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(unit, parent row, ordinal in its text, number of units per text) of texts cut after each line break."""
    pieces = pc.split_pattern(text, "\n")
    flat, parent, lengths = pc.list_flatten(pieces), pc.list_parent_indices(pieces), pc.list_value_length(pieces)
    starts = pc.subtract(pc.cumulative_sum(pc.cast(lengths, pa.int64())), lengths)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parent))
    last = pc.equal(ordinal, pc.subtract(pc.take(lengths, parent), 1))
    unit = pc.binary_join_element_wise(flat, pc.if_else(last, "", "\n"), "")
    there = pc.not_equal(pc.binary_length(unit), 0)  # after a last line break, and in an empty text, no unit follows
    dropped = pc.cast(pc.or_(pc.equal(text, ""), pc.ends_with(text, "\n")), pa.int64())
    return unit.filter(there), parent.filter(there), ordinal.filter(there), pc.subtract(lengths, dropped)


def _modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(b, pc.divide(a, b)))


def _joined(unit: pa.Array, role: pa.Array, which: int, counts: pa.Array) -> pa.Array:
    """The units of one role as one string per text."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, unit.filter(pc.equal(role, which))), "")


def _transformer(marks: Marks, percent: int, spm_percent: int, schema: pa.Schema):
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, text, h1, h2, h3, h4 = batch.columns
        text = pc.fill_null(text.cast(pa.string()), "")
        unit, parent, ordinal, n = units(text)
        places = pc.add(n, 1)
        at, to = _modulo(h1, places), _modulo(h2, places)
        a, b = pc.min_element_wise(at, to), pc.max_element_wise(at, to)
        role = pc.if_else(pc.less(ordinal, pc.take(a, parent)), 0, pc.if_else(pc.less(ordinal, pc.take(b, parent)), 1, 2))
        prefix, middle, suffix = (_joined(unit, role, k, c) for k, c in enumerate((a, pc.subtract(b, a), pc.subtract(n, b))))
        marked = [pc.match_substring(text, m) for m in marks]
        plain = pc.or_(pc.or_(pc.equal(text, ""), pc.or_(pc.or_(*marked[:2]), marked[2])), pc.greater_equal(_modulo(h3, 100), percent))
        form = pc.if_else(plain, "plain", pc.if_else(pc.less(_modulo(h4, 100), spm_percent), "spm", "psm"))
        psm = pc.binary_join_element_wise(marks.prefix, prefix, marks.suffix, suffix, marks.middle, middle, "")
        spm = pc.binary_join_element_wise(marks.suffix, suffix, marks.prefix, prefix, marks.middle, middle, "")
        output = pc.if_else(plain, text, pc.if_else(pc.equal(form, "spm"), spm, psm))
        chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
        return pa.RecordBatch.from_arrays([ids, pc.cast(n, pa.int64()), form, *chars, output], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                out = cut(part)
                yield out if out.schema == schema else out.cast(schema)

    return run


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    marks: Marks = Marks(),
) -> DataFrame:
    """One row per input row: id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    A unit is a line with its break. ``percent`` of the texts are cut, ``spm_percent`` of those with the suffix first; the
    rest, empty and null texts and texts that hold a mark stay plain (``prefix_chars`` and ``middle_chars`` null). The cut
    depends on ``seed`` and the id written as text (a null id as the empty text), so repeated rows come out alike. Ids
    may have any type. Extra columns are ignored. An empty table gives an empty result. A text is one Arrow value, so it
    and its output have to stay below 2 GB.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"__h{k}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *h)
    kind = docs.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    ddl = f"`{id_col}` {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_transformer(marks.checked(), percent, spm_percent, schema), ddl)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The exact text of an output: no cut text holds a mark, so the first of each kind is the one put there."""

    def after(s: Column, head: Column | int) -> Column:
        return F.substr(s, F.lit(1) + head)

    def taken(first: str, then: str) -> tuple[Column, Column, Column]:
        body = after(output, F.lit(len(first)))
        one = F.substring_index(body, then, 1)
        rest = after(body, F.char_length(one) + len(then))
        two = F.substring_index(rest, marks.middle, 1)
        return one, two, after(rest, F.char_length(two) + len(marks.middle))

    prefix, suffix, middle = taken(marks.prefix, marks.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = taken(marks.suffix, marks.prefix)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


#: The same by SQL: units by pattern, cuts by the digest of the id, output and its text digests.
ORACLE = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
parts AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM hashed),
cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM parts),
texts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM texts
"""
