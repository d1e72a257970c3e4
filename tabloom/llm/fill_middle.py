"""Operator 12: fill-in-the-middle by block rotation in place.

A text's bytes are scanned for line ends; two cuts on line borders make a prefix, a middle and a suffix. The sentinels go
into one bytearray at the cuts, and segments are exchanged by rotations of three reversals each:

- <P>prefix<M>middle<S>suffix, the order in which sentinels are inserted, becomes
- psm, <P>prefix<S>suffix<M>middle, by rotating what follows the prefix;
- spm, <S>suffix<P>prefix<M>middle, by rotating the whole.

The text comes back by the opposite rotation and by taking the sentinels out. Sentinels neither overlap one another nor
occur in a text that is changed, so the first place of each is its own.

Cuts and forms follow a hash of the seed and the id, so they do not depend on partitions. A null id counts as the empty
text there, a null text as empty; empty texts, and those that hold a sentinel, stay plain. Rows that repeat an id are cut
by the same draws, each in its own text. A text is one bytearray, whatever its length; bytes that are no UTF-8 stay as
they are. An empty table gives no rows. Other columns are kept by fill_in_middle() and restore_texts() and are not read
by middle_digests(), so names cannot clash with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import table

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    """Marks of the three segments. None may begin with what another ends with, so that they cannot overlap."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j))):
                    raise ValueError("sentinels must be different, not empty, and must not overlap")


MARKS = Sentinels()


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from the seed and an id."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))


def reverse(block: np.ndarray) -> None:
    """Reverses a block in place, with room for half of it."""
    half = len(block) // 2
    held = block[:half].copy()
    block[:half] = block[len(block) - half :][::-1]
    block[len(block) - half :] = held[::-1]


def rotate(block: np.ndarray, cut: int) -> None:
    """Exchanges block[:cut] and block[cut:] in place: each is reversed, then the whole."""
    reverse(block[:cut])
    reverse(block[cut:])
    reverse(block)


def line_ends(raw: bytes) -> np.ndarray:
    """Where each line ends: after its line feed, the last line where the text ends."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.append(ends, len(raw)) if len(raw) and (not len(ends) or ends[-1] != len(raw)) else ends


@dataclass
class Rotated:
    """The changed bytes, their form, and the bytes of prefix and middle where there are any."""

    output: bytearray
    form: str
    prefix: bytes | None = None
    middle: bytes | None = None


def rotated(raw: bytes, numbers: tuple[int, int, int, int], rate: int = 100, spm_rate: int = 50, marks: Sentinels = MARKS) -> Rotated:
    """Cuts a text by four numbers: two cuts, whether it is changed (`rate` in 100), and whether to spm (`spm_rate` in 100)."""
    one, two, chance, kind = numbers
    if not raw or chance % 100 >= rate or any(m in raw for m in (marks.prefix, marks.suffix, marks.middle)):
        return Rotated(bytearray(raw), PLAIN)
    ends = line_ends(raw)
    lo, hi = sorted((one % (len(ends) + 1), two % (len(ends) + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (lo, hi))
    out = bytearray(raw)
    out[b:b] = marks.suffix
    out[a:a] = marks.middle
    out[:0] = marks.prefix
    head = len(marks.prefix) + a  # bytes before the middle's mark
    view = np.frombuffer(out, np.uint8)
    middle = len(marks.middle) + b - a
    if kind % 100 < spm_rate:
        rotate(view, head + middle)
        form = SPM
    else:
        rotate(view[head:], middle)
        form = PSM
    del view
    return Rotated(out, form, raw[:a], raw[a:b])


def restored(output: bytes, form: str, marks: Sentinels = MARKS) -> bytearray:
    """The exact text of an output and its form, by the opposite rotation."""
    out = bytearray(output)
    if form == PLAIN:
        return out
    if form == PSM:
        first, second = out.index(marks.suffix), out.index(marks.middle)
    elif form == SPM:
        first, second = 0, out.index(marks.prefix)
    else:
        raise ValueError(f"unknown form {form}")
    view = np.frombuffer(out, np.uint8)
    rotate(view[first:], second - first)
    del view
    for mark in (marks.suffix, marks.middle, marks.prefix):  # from the end on
        at = out.index(mark)
        del out[at : at + len(mark)]
    return out


def characters(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).sum())


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form_col: str = "form", seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: Sentinels = MARKS) -> DataFrame:
    """All rows and columns, the text in its form and the form in a column of its own, which replaces one of that name. Null texts become empty."""
    kept = [c for c in docs.columns if c != form_col]
    place, ids = kept.index(text_col), kept.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [rotated(raw, draws(seed, key), rate, spm_rate, marks) for key, raw in zip(b.column(ids).to_pylist(), _bytes(b.column(place)), strict=True)]
            columns = [*b.columns, pa.array([m.form for m in made], pa.string())]
            columns[place] = pa.array([bytes(m.output) for m in made], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, form_col])

    return docs.select(kept).mapInArrow(run, docs.select(kept).schema.add(form_col, "string"))


def restore_texts(filled: DataFrame, text_col: str = "text", form_col: str = "form", marks: Sentinels = MARKS) -> DataFrame:
    """All rows and columns but the form, with the texts as they were. A null form is plain."""
    kept = [c for c in filled.columns if c != form_col]
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[:-1])
            back = [bytes(restored(raw, form or PLAIN, marks)) for raw, form in zip(_bytes(columns[place]), b.column(len(kept)).to_pylist(), strict=True)]
            columns[place] = pa.array(back, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return filled.select(*kept, form_col).mapInArrow(run, filled.select(kept).schema)


def middle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: Sentinels = MARKS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row; n counts lines."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in fields]
            for key, raw in zip(b.column(0).to_pylist(), _bytes(b.column(1)), strict=True):
                made = rotated(raw, draws(seed, key), rate, spm_rate, marks)
                sizes = (None, None) if made.prefix is None else (characters(made.prefix), characters(made.middle))
                back = restored(made.output, made.form, marks)
                for column, value in zip(rows, (len(line_ends(raw)), made.form, *sizes, hashlib.sha256(made.output).hexdigest(), hashlib.sha256(back).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(rows, fields.values(), strict=True))], names=["id", *fields])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as h from documents),
l as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as lines, [('0x' || substr(h, 1 + 8 * k, 8))::bigint for k in range(4)] as r from d),
c as (select *, len(lines) as n, t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100 as plain from l),
u as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b from c),
s as (select doc_id, t, n, plain, r, array_to_string(lines[1:a], '') as p, array_to_string(lines[a + 1:b], '') as m, array_to_string(lines[b + 1:], '') as s from u)
select doc_id, n::bigint as n, case when plain then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form,
  case when not plain then length(p) end::bigint as prefix_chars, case when not plain then length(m) end::bigint as middle_chars,
  sha256(case when plain then t when r[4] % 100 < 50 then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256 from s"""
