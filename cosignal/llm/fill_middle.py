"""Fill-in-middle transformation on piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: its
own UTF-8 text and one that holds the sentinels. Cutting splits a descriptor, an arrangement
permutes descriptors, and nothing is copied until the output is written; digests are fed from
the descriptors piece by piece. The output is taken apart again the same way: descriptors over
the output's bytes between the sentinels, put back by the inverse permutation.

A sentinel starts with ``<``, ends with ``>`` and holds neither inside, so it cannot overlap
itself or another one; a text that holds a sentinel stays plain. So the sentinels found in an
output, left to right, are exactly those written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, MARKS = 0, 1
SENTINELS = (b"<P>", b"<S>", b"<M>")
MARK_BUFFER = b"".join(SENTINELS)
BLOCK = 1 << 16              # bytes per counting block
BATCH_BYTES = 16 << 20       # output bytes per Arrow batch (one text, if longer)


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


P, S, M = (Piece(MARKS, 3 * i, 3) for i in range(3))

#: Per form: which descriptor of (P, prefix, S, suffix, M, middle) stands at each place.
ORDERS = {"psm": (0, 1, 2, 3, 4, 5), "spm": (2, 3, 0, 1, 4, 5)}


@dataclass(frozen=True)
class Rates:
    seed: int = 1
    transformed: int = 90    # percent of the texts that are rearranged
    spm: int = 20            # percent of those that start with the suffix


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The same text with a descriptor boundary ``at`` bytes from its start."""
    out, seen = [], 0
    for p in pieces:
        left = at - seen
        if 0 <= left <= p.length:
            out += [Piece(p.buffer, p.start, left), Piece(p.buffer, p.start + left, p.length - left)]
            at = -1
        else:
            out.append(p)
        seen += p.length
    return out


def arrange(pieces: list[Piece], order: tuple[int, ...]) -> list[Piece]:
    return [pieces[i] for i in order]


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    back = [0] * len(order)
    for place, i in enumerate(order):
        back[i] = place
    return tuple(back)


def stream(pieces: list[Piece], buffers: tuple[bytes, bytes]) -> Iterator[memoryview]:
    views = [memoryview(b) for b in buffers]
    for p in pieces:
        yield views[p.buffer][p.start:p.start + p.length]


def digest(pieces: list[Piece], buffers: tuple[bytes, bytes]) -> str:
    h = hashlib.sha256()
    for view in stream(pieces, buffers):
        h.update(view)
    return h.hexdigest()


class Units:
    """Where the units of a text start: a run of letters A-Z, a-z, or one other character.
    Starts are counted per block of bytes, so a place is found without a list of all."""

    def __init__(self, text: bytes) -> None:
        b = np.frombuffer(text, np.uint8)
        folded = b | 0x20
        letter = (folded >= 97) & (folded <= 122)
        self.chars = (b & 0xC0) != 0x80
        self.starts = self.chars.copy()
        self.starts[1:] &= ~(letter[1:] & letter[:-1])
        edges = np.arange(0, len(b), BLOCK)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(self.starts, edges, dtype=np.int64))]) \
            if len(b) else np.zeros(1, np.int64)
        self.n = int(self.before[-1])

    def offset(self, unit: int) -> int:
        """Byte offset at which unit number ``unit`` starts (the end, for ``n``)."""
        if unit >= self.n:
            return len(self.starts)
        block = int(np.searchsorted(self.before, unit, "right")) - 1
        inside = np.flatnonzero(self.starts[block * BLOCK:(block + 1) * BLOCK])
        return block * BLOCK + int(inside[unit - self.before[block]])

    def characters(self, start: int, end: int) -> int:
        return int(np.count_nonzero(self.chars[start:end]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers from the document's id: 8 hex digits each of one SHA-256."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]


class Made(NamedTuple):
    n: int
    form: str
    pieces: list[Piece]
    prefix_chars: int | None
    middle_chars: int | None


def rearrange(doc_id: int | None, text: bytes, rates: Rates = Rates()) -> Made:
    """The descriptors of a document's output."""
    units = Units(text)
    whole = [Piece(TEXT, 0, len(text))]
    h1, h2, h3, h4 = draws(doc_id, rates.seed)
    if not text or h3 % 100 >= rates.transformed or any(s in text for s in SENTINELS):
        return Made(units.n, "plain", whole, None, None)
    first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.offset(first), units.offset(second)
    prefix, rest = cut(whole, a)
    middle, suffix = cut([rest], b - a)
    form = "spm" if h4 % 100 < rates.spm else "psm"
    pieces = arrange([P, prefix, S, suffix, M, middle], ORDERS[form])
    return Made(units.n, form, pieces, units.characters(0, a), units.characters(a, b))


def take_apart(output: bytes, form: str) -> list[Piece]:
    """Descriptors over ``output`` that spell the original text."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    order = ORDERS[form]
    marks = [SENTINELS[i // 2] for i in order[::2]]
    at = []
    for mark in marks:
        at.append(output.index(mark, at[-1] + 3 if at else 0))
    ends = [*at[1:], len(output)]
    found = [p for start, end in zip(at, ends) for p in (Piece(TEXT, start, 3), Piece(TEXT, start + 3, end - start - 3))]
    _, prefix, _, suffix, _, middle = arrange(found, inverse(order))
    return [prefix, middle, suffix]


PIECE = T.StructType().add("buffer", "integer").add("start", "long").add("length", "long")
MADE = {"n": "long", "form": "string", "output": "string", "pieces": T.ArrayType(PIECE),
        "prefix_chars": "long", "middle_chars": "long", "output_sha256": "string"}


def transform(docs: DataFrame, carry: list[str] | None = None, text: str = "text", doc_id: str = "doc_id",
              rates: Rates = Rates()) -> DataFrame:
    """One row per input row: struct ``doc`` with the ``carry`` columns (default all) and the
    columns of ``MADE``; ``pieces`` is the piece table behind ``output`` (buffer 0: the text's
    bytes, 1: the sentinels).

    A null text counts as empty and stays plain, a null id hashes as the empty string, repeated
    rows are cut alike, an empty table gives no rows; the input columns stay inside ``doc``, so
    they may have any names. Texts of any length are cut whole.
    """
    carry = docs.columns if carry is None else carry
    given = docs.select(F.struct(*[docs[c] for c in carry]).alias("doc"), docs[doc_id].cast("long").alias("_id"),
                        docs[text].cast("string").cast("binary").alias("_text"))
    schema = T.StructType([given.schema["doc"]])
    for name, kind in MADE.items():
        schema.add(name, kind)
    arrow = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, begun, held = batch.column("_id"), 0, 0
            rows: list[tuple] = []
            for i, value in enumerate(batch.column("_text")):
                t = value.as_py() or b""
                made = rearrange(ids[i].as_py(), t, rates)
                buffers = (t, MARK_BUFFER)
                output = b"".join(stream(made.pieces, buffers)) if made.form != "plain" else t
                rows.append((made.n, made.form, output, [p._asdict() for p in made.pieces], made.prefix_chars,
                             made.middle_chars, digest(made.pieces, buffers)))
                held += len(output)
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    n, form, out, pieces, before, middle, sha = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc").slice(begun, len(rows)), pa.array(n, pa.int64()), pa.array(form),
                         pa.array(out, pa.binary()).cast(pa.string()), pa.array(pieces, arrow),
                         pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(sha)],
                        names=["doc", *MADE])
                    begun, held, rows = i + 1, 0, []

    return given.mapInArrow(run, schema)


def restore(made: DataFrame, carry: list[str], output: str = "output", form: str = "form",
            keep_text: bool = True) -> DataFrame:
    """The ``carry`` columns, the original ``text`` (unless ``keep_text`` is off) and
    ``restored_sha256``, both from the output and its form alone."""
    given = made.select(*carry, F.col(output).cast("binary").alias("_output"), F.col(form).alias("_form"))
    schema = T.StructType([given.schema[c] for c in carry])
    if keep_text:
        schema.add("text", "string")
    schema.add("restored_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sums = [], []
            for out, kind in zip(batch.column("_output"), batch.column("_form")):
                buffers = (out.as_py(), MARK_BUFFER)
                pieces = take_apart(buffers[0], kind.as_py())
                sums.append(digest(pieces, buffers))
                if keep_text:
                    texts.append(b"".join(stream(pieces, buffers)))
            found = [pa.array(texts, pa.binary()).cast(pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *found, pa.array(sums, pa.string())],
                                             names=[f.name for f in schema])

    return given.mapInArrow(run, schema)
