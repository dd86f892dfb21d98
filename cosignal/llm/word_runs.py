"""Periodic runs of words, found with string synchronising sets.

A run is a maximal stretch of words with smallest period q that repeats at least four times.
Runs of period 1 to 3 are read off directly. For every dyadic scale s = 4, 8, ... the runs with
s <= q < 2s come from a synchronising set: a word position i belongs to it when, among the
hashes of the s-word windows that start in [i, i + s], the smallest is the first or the last.
Windows of period s/4 or less are left out of that minimum: they lie in runs found at smaller
scales, which supply those periods, so long stretches of one short period add no positions.

Membership depends only on the 2s words from i on, and unless all windows of [i, i + 2s) are
left out, [i, i + s) holds a member. In a run of length 4q or more with s <= q < 2s not all are
(else a period of s/4 or less would divide q), so some member i and its shift i + q both lie in
the run with equal contexts of 2s words, and no nearer equal context exists. So the distances
between neighbouring equal contexts propose every period. Pairs with the same distance chain
into stretches that miss a run's ends by less than s; these are compared word by word, so a
hash collision cannot make a run.

Documents are laid end to end in slices, each closed by a word of its own; a scale only holds
the documents that are long enough for it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_LENGTH = 6      # words; shorter stretches are no runs
REPEATS = 4           # a run is at least this many periods long
DIRECT = 3            # periods up to this one are read off word by word
STEPS = 256           # scales up to this one widen their chains word by word, all at once
SLICE_WORDS = 300_000

Edit = Callable[[list[bytes], int | None], list[bytes]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true flags of ``least`` or more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def window_minimum(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours: blockwise running minima from both sides."""
    n = len(x)
    padded = np.full(-(-n // size) * size, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, size)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - size + 1], left[size - 1:n])


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the positions inside any [start, end)."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def synchronising_set(h: np.ndarray, s: int, left_out: np.ndarray) -> np.ndarray:
    """Positions chosen from the hashes of the s-word windows."""
    top = np.uint64(np.iinfo(np.uint64).max)
    open_ = np.where(left_out, top, np.minimum(h, top - np.uint64(1)))
    least = window_minimum(open_, s + 1)
    n = len(least)
    return np.flatnonzero((least != top) & ((least == open_[:n]) | (least == open_[s:s + n])))


def proposals(h: np.ndarray, s: int, left_out: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of neighbouring equal contexts s to 2s - 1 words apart."""
    if len(h) <= 2 * s:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = synchronising_set(h, s, left_out)
    context = mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + s])
    order = np.argsort(context, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    d = b - a
    good = (context[order[:-1]] == context[order[1:]]) & (d >= s) & (d < 2 * s) & (doc[a] == doc[b])
    return a[good], d[good]


def widen(seq: np.ndarray, begin: np.ndarray, end: np.ndarray, d: np.ndarray, steps: int) -> None:
    """Move the ends of all stretches outwards, in place, while the words ``d`` apart stay
    equal, at most ``steps`` words a side; all stretches move together."""
    left = right = np.arange(len(begin))
    for _ in range(steps):
        left = left[begin[left] > 0]
        left = left[seq[begin[left] - 1] == seq[begin[left] - 1 + d[left]]]
        begin[left] -= 1
        right = right[end[right] + d[right] < len(seq)]
        right = right[seq[end[right]] == seq[end[right] + d[right]]]
        end[right] += 1
        if not len(left) and not len(right):
            return


def verified(seq: np.ndarray, begin: int, end: int, d: int, reach: int) -> list[tuple[int, int]]:
    """[start, end) of the words of distance-d stretches around words [begin, end) that are at
    least ``REPEATS`` periods long, compared word by word."""
    while True:
        lo, hi = max(begin - reach, 0), min(end + reach, len(seq) - d)
        equal = seq[lo:hi] == seq[lo + d:hi + d]
        # Enough once a mismatch (or the end of the words) bounds the stretch on both sides.
        if (lo == 0 or not equal[:begin - lo].all()) and (hi == len(seq) - d or not equal[end - lo:].all()):
            break
        reach *= 2
    start, stop = stretches(equal, (REPEATS - 1) * d)
    return [(int(a) + lo, int(b) + lo + d) for a, b in zip(start, stop)]


def find_runs(seq: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of ``REPEATS`` periods or more in ``seq``, in which
    every document (numbered by ``doc``, with ``sizes`` words) is closed by a word that occurs
    once. Ordered by start, then period."""
    found: dict[tuple[int, int], int] = {}       # (start, end) -> smallest period
    for q in range(1, DIRECT + 1):
        start, end = stretches(seq[q:] == seq[:-q], (REPEATS - 1) * q)
        for a, b in zip(start.tolist(), (end + q).tolist()):
            found.setdefault((a, b), q)

    # Hashes of s-word windows; ``where`` maps the words of long enough documents to ``seq``.
    h = mix(seq.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    where = np.arange(len(seq))
    s = 1
    most = int(sizes.max(initial=0))
    while 2 * s * REPEATS <= most:
        h = np.concatenate([mix(h[:-s] * np.uint64(0xD6E8FEB86659FD93) + h[s:]), h[-s:]])
        s *= 2
        if s <= DIRECT:
            continue
        stay = sizes[doc[where]] >= REPEATS * s
        h, where = h[stay], where[stay]
        spot = doc[where]
        # Windows of period s/4 or less: those inside runs of the smaller scales.
        known = np.array([(a, b) for (a, b), q in found.items() if REPEATS * q <= s <= b - a],
                         np.int64).reshape(-1, 2)
        # A run lies inside one document, so its words keep their distance in ``where``.
        begin = np.searchsorted(where, known[:, 0])
        inside = begin < len(where)
        inside[inside] = where[begin[inside]] == known[inside, 0]
        begin, last = begin[inside], (known[:, 1] - known[:, 0])[inside] - s + 1
        left_out = covered(len(h), begin, begin + last)
        at, d = proposals(h, s, left_out, spot)
        if not len(at):
            continue
        # Chains: same distance, and contexts of 2s words that meet.
        order = np.lexsort((at, d))
        at, d = at[order], d[order]
        new = np.ones(len(at), bool)
        new[1:] = (d[1:] != d[:-1]) | (at[1:] > at[:-1] + 2 * s) | (spot[at[1:]] != spot[at[:-1]])
        first = np.flatnonzero(new)
        final = np.append(first[1:], len(at)) - 1
        chain, end, period = at[first], at[final] + 2 * s, d[first]
        # All chains are widened together at small scales, where they are many; at large ones
        # each is compared as a whole.
        worth = end - chain >= (REPEATS - 1) * period - 2 * s + 2
        begin, period = where[chain[worth]], period[worth]
        end, reach = begin + (end - chain)[worth], s
        if s <= STEPS:
            widen(seq, begin, end, period, s)
            worth = end - begin >= (REPEATS - 1) * period
            begin, end, period, reach = begin[worth], end[worth], period[worth], 1
        for a, e, q in zip(begin.tolist(), end.tolist(), period.tolist()):
            for run in verified(seq, a, e, q, reach):
                found.setdefault(run, q)
    table = np.array([(a, b, q) for (a, b), q in found.items()], np.int64).reshape(-1, 3)
    table = table[(table[:, 1] - table[:, 0]) >= LEAST_LENGTH]
    table = table[np.lexsort((table[:, 2], table[:, 0]))]
    return table[:, 0], table[:, 1], table[:, 2]


def runs_of_texts(texts: list[list[bytes]]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Per word list: the words and their runs as rows (start, length, period)."""
    begun = 0
    while begun < len(texts):
        held, stop = 0, begun
        while stop < len(texts) and (stop == begun or held + len(texts[stop]) <= SLICE_WORDS):
            held += len(texts[stop])
            stop += 1
        part = texts[begun:stop]
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        sizes = np.array([len(w) for w in part], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        seq = np.empty(held + len(part), np.int64)
        inside = np.ones(len(seq), bool)
        inside[ends] = False
        seq[inside] = np.fromiter((number[w] for words in part for w in words), np.int64, held)
        seq[ends] = len(number) + np.arange(len(part))
        doc = np.repeat(np.arange(len(part)), sizes + 1)
        start, end, period = find_runs(seq, doc, sizes)
        owner = doc[start]
        offset = ends - sizes
        cuts = np.searchsorted(owner, np.arange(len(part) + 1))
        for i, words in enumerate(part):
            rows = slice(cuts[i], cuts[i + 1])
            yield words, np.stack([start[rows] - offset[i], end[rows] - start[rows], period[rows]], 1)
        begun = stop


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    gone = covered(len(words), runs[:, 0] + runs[:, 2], runs[:, 0] + runs[:, 1])
    return [words[i] for i in np.flatnonzero(~gone)]


COLUMNS = {"n_words": "long", "n_runs": "long", "start": "long", "length": "long", "period": "long",
           "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}
RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))


def detect(docs: DataFrame, carry: list[str] | None = None, text: str = "text", doc_id: str = "doc_id",
           edit: Edit | None = None, keep_text: bool = True) -> DataFrame:
    """One row per input row: struct ``doc`` with the ``carry`` columns (default all), the
    digest columns of ``COLUMNS`` for the run of greatest length (ties: smallest start, then
    period) and, unless ``keep_text`` is off, all ``runs`` and the ``collapsed`` text.

    ``edit`` may replace a document's words first (it gets them with the id). A null or blank
    text has no words and no run; its digests are those of the empty string. Repeated rows get
    equal results, an empty table gives no rows, and the input columns stay inside ``doc``, so
    they may have any names. A text is taken whole, however long.
    """
    carry = docs.columns if carry is None else carry
    given = docs.select(F.struct(*[docs[c] for c in carry]).alias("doc"), docs[doc_id].cast("long").alias("_id"),
                        docs[text].cast("string").cast("binary").alias("_text"))
    schema = T.StructType([given.schema["doc"]])
    for name, kind in COLUMNS.items():
        schema.add(name, kind)
    if keep_text:
        schema.add("runs", RUNS)
        schema.add("collapsed", "string")
    arrow_runs = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from judge(part)

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows whose texts have some 16 MB together, so few words are held at once."""
        begun = held = 0
        for i, value in enumerate(batch.column("_text")):
            held += len(value.as_buffer() or b"")
            if held >= 16 << 20 or i + 1 == batch.num_rows:
                yield batch.slice(begun, i + 1 - begun)
                begun, held = i + 1, 0

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [(t.as_py() or b"").split() for t in batch.column("_text")]
        if edit is not None:
            texts = [edit(w, i.as_py()) for w, i in zip(texts, batch.column("_id"))]
        rows, all_runs, kept = [], [], []
        for words, found in runs_of_texts(texts):
            best = (None,) * 4
            if len(found):
                start, length, period = max(found.tolist(), key=lambda r: (r[1], -r[0], -r[2]))
                best = (start, length, period, 1000 * length // period)
            listed = "".join("%d,%d,%d\n" % tuple(r) for r in found.tolist())
            short = b" ".join(collapse(words, found))
            rows.append((len(words), len(found), *best, hashlib.sha256(listed.encode()).hexdigest(),
                         hashlib.sha256(short).hexdigest()))
            if keep_text:
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in found.tolist()])
                kept.append(short)
        made = [pa.array(c, pa.string() if kind == "string" else pa.int64())
                for c, kind in zip(zip(*rows), COLUMNS.values())]
        if keep_text:
            made += [pa.array(all_runs, arrow_runs), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *made], names=[f.name for f in schema])

    return given.mapInArrow(run, schema)
