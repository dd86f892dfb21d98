"""Quality rules: counts per document and repetition found with a suffix array.

The words of many documents are laid end to end, each document closed by a mark that
occurs once, and sorted as suffixes by prefix doubling: after round k the suffixes are
ranked by their first 2^k words, and only those whose rank is still shared are sorted
again. Ranks start as (document, word), so suffixes of different documents never tie.
The longest common prefix of neighbours in the suffix array comes from a binary search over
polynomial prefix hashes (two 31-bit moduli), so no round's ranks need be kept but those of the
shortest repeat's length. The innermost LCP interval around a suffix has the larger
of its two neighbouring LCP values, and that prefix is a maximal repeated substring;
the union of these spans is the repeated part of the document.

Everything is vectorised over slices of some 10^5 words inside Arrow batches; a task
holds one slice (or one document, if longer) at a time and nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK_BYTES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8          # words in a window of the base rule
SLICE_WORDS = 300_000


@dataclass(frozen=True)
class Limits:
    min_words: int = 20             # base: fewer words fail
    max_repeat_percent: int = 30    # base: more of the words in repeated windows fail
    min_repeat: int = 16            # shortest repeat, in words, whose span counts
    max_covered: float = 0.25       # method: larger covered fraction is rejected
    max_longest: int = 100          # method: a longer repeated substring is rejected


PRIMES = (2_147_483_647, 2_147_483_629)     # moduli of the prefix hashes
BASES = (1_103_515_245, 1_664_525_013)


def suffix_ranks(seq: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Suffix array of ``seq``, the rank of every position by its first 2^level items (None, if
    all suffixes differ before), and the number of rounds. ``seq`` must end every part with an
    item that occurs only once."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable").astype(np.int32)
    ordered = seq[sa]
    head = np.ones(n + 1, bool)
    head[1:n] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head[:n], np.arange(n, dtype=np.int32), 0))
    kept, rounds, h = None, 0, 1
    while True:
        if rounds == level:
            kept = rank.copy()
        rounds += 1
        slots = np.flatnonzero(~(head[:n] & head[1:]))   # suffixes whose rank is shared
        if not len(slots):
            return sa, kept, rounds
        open_ = sa[slots]
        key = rank[open_].astype(np.int64) * n + rank[open_ + h]
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        sa[slots] = open_
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        head[slots] = first
        rank[open_] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        h *= 2


class PrefixHash:
    """Sums of item * base^place modulo a prime: equal stretches have equal differences, up to the
    power of the base that their distance is."""

    def __init__(self, seq: np.ndarray, prime: int, base: int) -> None:
        n, self.p = len(seq), np.uint64(prime)
        power = np.ones(n + 1, np.uint64)
        size, step = 1, np.uint64(base)                  # step = base^size
        while size <= n:
            power[size:2 * size] = power[:min(size, n + 1 - size)] * step % self.p
            step = step * step % self.p
            size *= 2
        self.power = power.astype(np.uint32)
        term = (seq.astype(np.uint64) % self.p + np.uint64(1)) * power[:n] % self.p
        del power
        total = np.concatenate([[np.uint64(0)], np.cumsum(term)])      # below 2^31 * n
        self.sum = (total % self.p).astype(np.uint32)

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether the ``size`` items from a and from b (a < b) hash alike."""
        u = lambda x: self.sum[x].astype(np.uint64)
        left = (u(a + size) + self.p - u(a)) % self.p * self.power[b - a].astype(np.uint64) % self.p
        return left == (u(b + size) + self.p - u(b)) % self.p


def longest_matches(seq: np.ndarray, least: int) -> np.ndarray:
    """For every position the length of the longest prefix of its suffix that occurs
    elsewhere too, 0 where that is under ``least`` (a power of two)."""
    sa, near, rounds = suffix_ranks(seq, least.bit_length() - 1)
    out = np.zeros(len(seq), np.int32)
    if near is None:
        return out
    r = np.flatnonzero(near[sa[1:]] == near[sa[:-1]])
    del near
    a, b = np.minimum(sa[r], sa[r + 1]).astype(np.int64), np.maximum(sa[r], sa[r + 1]).astype(np.int64)
    del sa, r
    lcp = np.full(len(a), least, np.int64)
    hashes = [PrefixHash(seq, p, base) for p, base in zip(PRIMES, BASES)] if len(a) else []
    for k in range(rounds, -1, -1) if hashes else ():
        fits = np.flatnonzero(b + lcp + (1 << k) <= len(seq))
        x, y = a[fits] + lcp[fits], b[fits] + lcp[fits]
        good = hashes[0].equal(x, y, 1 << k) & hashes[1].equal(x, y, 1 << k)
        lcp[fits[good]] += 1 << k
    np.maximum.at(out, a, lcp.astype(np.int32))
    np.maximum.at(out, b, lcp.astype(np.int32))
    return out


def repetition(tokens: np.ndarray, doc: np.ndarray, sizes: np.ndarray, least: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words in repeated windows of 8, words covered by repeats of at least
    ``least`` words, and the longest repeat. ``doc`` numbers the documents of ``tokens``."""
    docs = len(sizes)
    ends = np.cumsum(sizes + 1) - 1                       # where the closing marks go
    seq = np.empty(len(tokens) + docs, np.int64)
    inside = np.ones(len(seq), bool)
    inside[ends] = False
    vocabulary = int(tokens.max(initial=0)) + 2
    seq[inside] = doc * vocabulary + tokens + 1
    seq[ends] = np.arange(docs) * vocabulary
    owner = np.empty(len(seq), np.int64)
    owner[inside] = doc
    owner[ends] = np.arange(docs)
    power = 1 << (min(WINDOW, least).bit_length() - 1)
    match = longest_matches(seq, power)

    def covered(shortest: int) -> np.ndarray:
        start = np.flatnonzero(match >= shortest)
        edge = np.zeros(len(seq) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + match[start], -1)
        return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=docs)

    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, owner, np.where(match >= least, match, 0))
    return covered(WINDOW), covered(least), longest


def measure(texts: list[bytes | None], limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """All counts of the rules for a list of UTF-8 texts (None counts as empty)."""
    out = {k: np.zeros(len(texts), np.int64) for k in
           ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "covered_words", "longest_repeat")}
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    tokens: list[np.ndarray] = []
    begun = held = 0

    def flush(end: int) -> None:
        nonlocal begun, held
        if held:
            sizes = out["n_words"][begun:end]
            doc = np.repeat(np.arange(end - begun), sizes)
            found = repetition(np.concatenate(tokens), doc, sizes, limits.min_repeat)
            for name, values in zip(("n_repeat_words", "covered_words", "longest_repeat"), found):
                out[name][begun:end] = values
        tokens.clear()
        number.clear()
        begun, held = end, 0

    for i, t in enumerate(texts):
        if t:
            words = t.split()
            if held + len(words) > SLICE_WORDS:
                flush(i)
            out["n_words"][i] = len(words)
            out["word_chars"][i] = len(t.translate(None, BLANK_BYTES + CONTINUATION))
            out["n_symbols"][i] = len(t) - len(t.translate(None, SYMBOLS))
            lines = [line for line in t.split(b"\n") if line.strip()]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
            if words:
                tokens.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                held += len(words)
    flush(len(texts))
    n = out["n_words"]
    out["base_failed"] = ((n < limits.min_words)
                          | (100 * out["n_repeat_words"] > limits.max_repeat_percent * n))
    out["kept"] = ~(out["base_failed"] | (out["covered_words"] > limits.max_covered * n)
                    | (out["longest_repeat"] > limits.max_longest))
    return out


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
           "n_repeat_words": "long", "covered_words": "long", "longest_repeat": "long",
           "base_failed": "boolean", "kept": "boolean"}


def judge(docs: DataFrame, carry: list[str] | None = None, text: str = "text",
          limits: Limits = Limits()) -> DataFrame:
    """One row per input row: struct ``doc`` with the ``carry`` columns (default all) and
    the counts and verdict in ``COLUMNS``.

    Null and blank texts have no words and fail the base rule; repeated rows are judged
    alike; an empty table gives no rows; because the input columns stay inside ``doc``,
    they may have any names. Repeats within a text only: other documents never matter.
    """
    carry = docs.columns if carry is None else carry
    given = docs.select(F.struct(*[docs[c] for c in carry]).alias("doc"),
                        docs[text].cast("string").cast("binary").alias("_text"))
    schema = T.StructType([given.schema["doc"]])
    for name, kind in COLUMNS.items():
        schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column("_text").to_pylist(), limits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(found[c]) for c in COLUMNS)],
                names=["doc", *COLUMNS])

    return given.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows that pass, with exactly the input columns."""
    return judge(docs, text=text, limits=limits).filter("kept").select("doc.*")
