"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. The vector of the trigram abc binds
the letters' vectors, permuted by their place: shift²(a) * shift(b) * c. A text's vector
bundles (adds) the vectors of its trigrams; a language's prototype bundles the trigrams of
its training texts. The language whose prototype has the largest cosine wins.

Because bundling is a sum, prototypes are built from trigram counts: tasks count, Spark
adds the counts up by (lang, trigram), and each trigram's vector enters once with its
weight. Letter vectors come from the letter's code point by a hash, so every task has the
same ones without sharing anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosignal.llm.common import column

DIM = 512
SEED = 20259
MAX_LANGS = 4096          # prototypes travel to every task, so their number is checked
GAP = 32                  # a blank: everything that is not a letter, runs of it as one
ROWS = 256                # texts bundled in one matrix product
GRAMS = 8192              # distinct trigrams in one matrix product
SLICE_CHARS = 1_000_000   # characters looked at together


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A +1/-1 row per code point, a fixed pseudo-random function of the point: the bits of
    a 64-bit mixer over (point, word number)."""
    words = dim // 64
    with np.errstate(over="ignore"):
        x = ((points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64))
             + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def trigram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The bound vector of each trigram of code points (a, b, c)."""
    points, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    v, n = letter_vectors(points, dim), len(a)
    return (np.roll(v, 2, axis=1)[at[:n]] * np.roll(v, 1, axis=1)[at[n:2 * n]] * v[at[2 * n:]])


Part = tuple[int, int, int]      # text number, first and last character (exclusive) counted


def parts(texts: list[str | None]) -> Iterator[list[Part]]:
    """The texts in lists of at most ``ROWS`` parts and ``SLICE_CHARS`` characters; a longer text
    comes in several parts."""
    held: list[Part] = []
    chars = 0
    for i, t in enumerate(texts):
        size = len(t or "")
        for lo in range(0, max(size, 1), SLICE_CHARS):
            hi = min(size, lo + SLICE_CHARS)
            if held and (len(held) >= ROWS or chars + hi - lo > SLICE_CHARS):
                yield held
                held, chars = [], 0
            held.append((i, lo, hi))
            chars += hi - lo
    if held:
        yield held


def trigrams(texts: list[str | None], some: list[Part]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The trigrams around every letter of the parts: which part each is in, its number among the
    distinct ones, and their three code points. Letters are lower-cased, everything else and the
    text's ends are GAPs; a trigram only needs its letter's two neighbours, so parts of a text
    add up to the whole."""
    strings = [(texts[i] or "")[max(0, lo - 1):hi + 1].replace("\x00", " ") for i, lo, hi in some]
    raw = np.frombuffer("\x00".join(["", *strings, ""]).encode("utf-32-le", "replace"), np.uint32)
    present, at = np.unique(raw, return_inverse=True)
    become = np.full(len(present), GAP, np.int64)
    for k, p in enumerate(present.tolist()):
        ch = chr(p)
        if ch.isalpha():
            low = ch.lower()
            become[k] = ord(low) if len(low) == 1 else p
    points, short = np.unique(become, return_inverse=True)
    flat = short.astype(np.int32)[at]
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes + 1)                                # the separator after each part
    centre = points[flat] != GAP
    # A neighbour taken along from the same text is no centre here.
    for (i, lo, hi), end, size in zip(some, ends.tolist(), sizes.tolist()):
        if lo > 0 and size:
            centre[end - size] = False
        if hi < len(texts[i] or "") and size:
            centre[end - 1] = False
    mid = np.flatnonzero(centre)
    k = len(points)
    code = (flat[mid - 1].astype(np.int64) * k + flat[mid]) * k + flat[mid + 1]
    own = np.searchsorted(ends, mid).astype(np.int32)
    if k ** 3 <= 8_000_000:
        seen = np.zeros(k ** 3, bool)
        seen[code] = True
        grams = np.flatnonzero(seen)
        number = np.zeros(k ** 3, np.int32)
        number[grams] = np.arange(len(grams))
        col = number[code]
    else:
        grams, col = np.unique(code, return_inverse=True)
    return own, col, [points[grams // (k * k)], points[grams // k % k], points[grams % k]]


def counted(own: np.ndarray, col: np.ndarray, rows: int, grams: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(trigram numbers, counts [rows x those trigrams]), at most ``GRAMS`` trigrams at a time."""
    if grams > GRAMS:
        order = np.argsort(col, kind="stable")
        own, col = own[order], col[order]
    cuts = np.searchsorted(col, np.arange(0, grams + GRAMS, GRAMS)) if grams > GRAMS else np.array([0, len(col)])
    for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        lo, hi = n * GRAMS, min(grams, (n + 1) * GRAMS)
        if hi > lo:
            slot = own[a:b].astype(np.int64) * (hi - lo) + (col[a:b] - lo)
            yield slice(lo, hi), np.bincount(slot, minlength=rows * (hi - lo)).reshape(rows, hi - lo)


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vector of every text, and whether it has a letter. Entries are whole numbers
    summed as doubles, so how a text is cut does not matter."""
    out, lettered = np.zeros((len(texts), DIM)), np.zeros(len(texts), bool)
    for some in parts(texts):
        own, col, abc = trigrams(texts, some)
        at = np.array([i for i, _, _ in some])
        lettered[at[np.unique(own)]] = True
        for which, counts in counted(own, col, len(some), len(abc[0])):
            vectors = trigram_vectors(*(x[which] for x in abc))
            np.add.at(out, at, (counts.astype(np.float32) @ vectors).astype(float)
                      if counts.sum() < 2 ** 24 else counts.astype(float) @ vectors)
    return out, lettered


def learn(texts: DataFrame) -> dict[str, np.ndarray]:
    """Prototype (unit vector) of every language in ``texts`` (columns text, lang; other
    columns are ignored). Rows without language or letters teach nothing. All rows are
    used; what reaches the driver is one vector per language, at most ``MAX_LANGS``.

    Within a language every trigram weighs its share, so long texts count by their length
    and large languages do not grow larger vectors.
    """
    given = texts.select(column(texts, "lang", "string").alias("lang"),
                         column(texts, "text", "string").alias("text")
                         ).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            body = batch.column("text").to_pylist()
            for some in parts(body):
                own, col, (a, b, c) = trigrams(body, some)
                of = langs[[i for i, _, _ in some]]
                for lang in dict.fromkeys(of):
                    total = np.bincount(col[(of == lang)[own]], minlength=len(a))
                    hit = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(hit), pa.string()), *(pa.array(x[hit].astype(np.int32)) for x in (a, b, c)),
                         pa.array(total[hit])], names=["lang", "a", "b", "c", "n"])

    summed = (given.mapInArrow(count, "lang string, a int, b int, c int, n long")
              .groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n")))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            a, b, c, n = (batch.column(k).to_numpy() for k in ("a", "b", "c", "n"))
            for at in range(0, len(n), 8192):
                part = slice(at, at + 8192)
                v = trigram_vectors(a[part], b[part], c[part]).astype(np.float64) * n[part, None]
                for x in dict.fromkeys(lang[part]):
                    sums[x] = sums.get(x, 0) + v[lang[part] == x].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                names=["lang", "v"])

    sums = summed.mapInArrow(bundle, "lang string, v array<double>")
    named = (sums.select("lang", F.posexplode("v").alias("i", "x"))
             .groupBy("lang", "i").agg(F.sum("x").alias("x"))
             .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))),
                                              lambda s: s["x"]).alias("v")))
    rows = named.orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    found = {r.lang: np.array(r.v) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in found.items() if np.any(v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], carry: list[str] = ("doc_id",)
            ) -> DataFrame:
    """(doc struct of ``carry``, lang_pred, score): the language with the largest cosine,
    ties to the first name; the score is that cosine, at least 0.

    Only the text is looked at. A null text, one without a letter, or any text when nothing
    was learned gets ``und`` with score 0. Repeated rows are predicted alike.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], float).reshape(len(names), DIM)
    given = docs.select(F.struct(*[docs[c] for c in carry]).alias("doc"),
                        column(docs, "text", "string").alias("_text"))
    schema = T.StructType([given.schema["doc"]]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            best = np.zeros(len(texts), np.int64)
            score = np.zeros(len(texts))
            bundled, lettered = bundles(texts)
            if names:
                size = np.linalg.norm(bundled, axis=1)
                cosine = (bundled @ matrix.T) / np.where(size > 0, size, 1)[:, None]
                best = cosine.argmax(axis=1)
                score = np.clip(cosine.max(axis=1), 0, 1)
            known = lettered & bool(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"),
                 pa.array([names[i] if ok else "und" for i, ok in zip(best, known)], pa.string()),
                 pa.array(np.where(known, score, 0.0).astype(np.float64))],
                names=["doc", "lang_pred", "score"])

    return given.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0.
    A null id is held out too: it cannot be assigned to the training part."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
