import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cosignal.llm import quality as Q
from cosignal.llm.queries import op9_quality

from .helpers import SF, empty, messy, words


def repeated(w, n=8):
    """Words in n-word windows that occur twice or more."""
    at = {}
    for i in range(len(w) - n + 1):
        at.setdefault(tuple(w[i:i + n]), []).append(i)
    return {i + k for v in at.values() if len(v) > 1 for i in v for k in range(n)}


def longest(w):
    best = 0
    for i in range(len(w)):
        for j in range(i):
            k = 0
            while i + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
    return best


def check(text, r):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
    assert r["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
    assert r["n_dup_lines"] == len(lines) - len(set(lines))
    rep = len(repeated(w))
    assert r["n_repeat_words"] == rep
    assert r["base_failed"] == (len(w) < 20 or 100 * rep > 30 * len(w))
    limits = Q.Limits()
    if len(w) < 400:
        cover, most = len(repeated(w, limits.min_repeat)), longest(w)
        assert r["covered_words"] == cover
        assert r["longest_repeat"] == (most if most >= limits.min_repeat else 0)
        assert r["kept"] == (not r["base_failed"] and cover <= limits.max_covered * len(w)
                             and r["longest_repeat"] <= limits.max_longest)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "c\n", "é#"]), max_size=90).map(" ".join)),
                max_size=6))
def test_small_alphabets_match_brute_force(texts):
    got = Q.measure([None if t is None else t.encode() for t in texts])
    for i, t in enumerate(texts):
        check(t, {k: v[i] for k, v in got.items()})


def test_slices_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 60))).encode() for _ in range(50)]
    whole = Q.measure(texts)
    monkeypatch.setattr(Q, "SLICE_WORDS", 30)
    parts = Q.measure(texts)
    assert all(np.array_equal(whole[k], parts[k]) for k in whole)


def test_prefix_hashes_tell_stretches_apart():
    rng = np.random.default_rng(5)
    seq = rng.integers(0, 3, 400)
    h = Q.PrefixHash(seq, Q.PRIMES[0], Q.BASES[0])
    a, b = np.triu_indices(380, 1)
    for size in (1, 5, 20):
        same = (np.lib.stride_tricks.sliding_window_view(seq, size)[a]
                == np.lib.stride_tricks.sliding_window_view(seq, size)[b]).all(1)
        assert np.array_equal(h.equal(a, b, size), same)


def test_long_repetitive_text_stays_small():
    """One word 4 million times: all its suffixes share long prefixes."""
    import subprocess
    import sys
    code = ("import resource\n"
            "from cosignal.llm import quality as Q\n"
            "t = b'x ' * 4_000_000\n"
            "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
            "m = Q.measure([t])\n"
            "assert m['longest_repeat'][0] == 3_999_999 and m['n_repeat_words'][0] == 4_000_000\n"
            "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)\n")
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert used < 700


def test_awkward_rows(spark):
    docs = messy(spark)
    got = Q.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        check(r.doc.text, r.asDict())
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and Q.keep_good(empty(spark)).count() == 0
    assert sorted(str(r) for r in kept.collect()) == sorted(str(r.doc) for r in got if r.kept)


def test_query_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_quality(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        check(texts[r.doc_id], r.asDict())
