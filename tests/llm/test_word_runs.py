import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cosignal.llm import word_runs as W
from cosignal.llm.queries import op13_word_runs, planted_period

from .helpers import SF, empty, messy, words


def brute(w):
    """All runs as (start, length, period), every period compared over the whole text."""
    number, out = {}, {}
    a = np.array([number.setdefault(x, len(number)) for x in w], int)
    for q in range(1, len(w) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (a[q:] == a[:-q]).astype(int), [0]])))
        for s, t in zip(edge[::2], edge[1::2]):
            if t - s + q >= max(6, 4 * q):
                out.setdefault((int(s), int(t + q)), q)
    return sorted((s, t - s, q) for (s, t), q in out.items())


def plant(w, doc_id):
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a, old = g % n, list(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    return w


def check(w, r):
    runs = brute(w)
    assert r.n_runs == len(runs)
    if runs:
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
        assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
    else:
        assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    return runs, kept


def rows(texts):
    return [[tuple(r) for r in found.tolist()] for _, found in W.runs_of_texts([[b"%d" % x for x in t] for t in texts])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=80), min_size=1, max_size=5))
def test_small_alphabets_match_brute_force(texts):
    assert rows(texts) == [brute(t) for t in texts]


def test_nested_periods_match_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        w = [rng.randint(0, 5) for _ in range(rng.choice([40, 150, 500]))]
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(w))
            p, end = rng.randint(1, max(1, (len(w) - a) // 3)), rng.randint(a, len(w))
            for i in range(a, end):
                w[i] = w[a + (i - a) % p]
        assert rows([w, w[::-1]]) == [brute(w), brute(w[::-1])]


def test_every_period_and_shift():
    for q in range(1, 70):
        for lead in (0, 1, 5):
            for length in (4 * q - 1, 4 * q, 4 * q + 1, 7 * q):
                w = [-1 - i for i in range(lead)] + [i % q for i in range(length)] + [-99, -98]
                assert rows([w]) == [brute(w)]


def test_wide_scales_without_stepping(monkeypatch):
    monkeypatch.setattr(W, "STEPS", 0)
    test_nested_periods_match_brute_force()


def test_slices_do_not_matter(monkeypatch):
    rng = random.Random(2)
    texts = [[rng.randint(0, 1) for _ in range(rng.randint(0, 90))] for _ in range(60)]
    whole = rows(texts)
    monkeypatch.setattr(W, "SLICE_WORDS", 40)
    assert rows(texts) == whole


def test_long_texts_stay_linear():
    """A million words of one kind, of a Fibonacci word (many short squares), and of a long period."""
    n = 1_000_000
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    assert rows([[7] * n]) == [[(0, n, 1)]]
    assert [len(f) for _, f in W.runs_of_texts([[c.encode() for c in b[:n]]])] == [0]
    assert rows([[i % 200_000 for i in range(n)]]) == [[(0, n, 200_000)]]


def test_synchronising_set_is_consistent():
    """Equal contexts of 2s words get equal membership."""
    rng = np.random.default_rng(3)
    seq = np.tile(rng.integers(0, 4, 60), 6)
    s, h = 4, W.mix(seq.astype(np.uint64))
    for k in (1, 2):
        h = np.concatenate([W.mix(h[:-k] * np.uint64(3) + h[k:]), h[-k:]])
    chosen = set(W.synchronising_set(h, s, np.zeros(len(h), bool)).tolist())
    by_context = {}
    for i in range(len(seq) - 2 * s):
        by_context.setdefault(tuple(seq[i:i + 2 * s]), set()).add(i in chosen)
    assert all(len(v) == 1 for v in by_context.values())


def test_awkward_rows(spark):
    docs = messy(spark)
    extra = spark.createDataFrame([(21, "a b " * 40), (22, "x " * 6), (23, "x " * 5), (24, "é é é é " * 30),
                                   (25, "same " * 200_000)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    got = W.detect(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        w = words(r.doc.text)
        if len(w) < 50_000:
            runs, kept = check(w, r)
            assert [tuple(x) for x in r.runs] == runs and r.collapsed == kept and r.n_words == len(w)
        else:
            assert (r.n_runs, r.start, r.length, r.period, r.collapsed) == (1, 0, 200_000, 1, "same")
    assert W.detect(empty(spark)).count() == 0


def test_planted_words():
    for doc_id in [*range(300), None]:
        w = [b"%d" % i for i in range(doc_id or 7)]
        assert planted_period(w, doc_id) == plant(w, doc_id)


def test_query_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op13_word_runs(spark, SF).collect()
    assert len(got) == len(texts)
    assert sum(len(check(plant(words(texts[r.doc_id]), r.doc_id), r)[0]) for r in got) > 0
