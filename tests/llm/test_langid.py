import numpy as np

from cosignal.llm import langid as L
from cosignal.llm.queries import op4_language_id

from .helpers import SF, empty, messy


def brute_vector(text):
    """Bundle of the trigrams' bound vectors, one trigram at a time."""
    s = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    s = " " + " ".join(s.split()) + " "
    if s.strip() == "":
        return np.zeros(L.DIM)
    v = {c: L.letter_vectors(np.array([ord(c)]))[0] for c in set(s)}
    return sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
               for a, b, c in zip(s, s[1:], s[2:]) if b != " ")


def test_bundles_match_brute_force():
    texts = ["Hello, WORLD!", "", None, "a", "12 3", "ünï\x00cödé  x", "Straße", "日本 語", "x" * 500 + " y"]
    got, lettered = L.bundles(texts)
    for t, g, has in zip(texts, got, lettered):
        want = brute_vector(t)
        assert np.allclose(g, want), t
        assert has == bool(want.any())
    assert not L.bundles([None, "", "1"])[1].any()


def test_cutting_texts_and_trigrams_does_not_matter(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(chr(c) for c in rng.choice([97, 98, 65, 32, 46, 0x4E00, 0x4E01, 0xE9], n)) for n in (0, 1, 7, 300)]
    whole, has = L.bundles(texts)
    for chars, grams, rows in ((1, 8192, 256), (3, 2, 2), (64, 7, 1)):
        monkeypatch.setattr(L, "SLICE_CHARS", chars)
        monkeypatch.setattr(L, "GRAMS", grams)
        monkeypatch.setattr(L, "ROWS", rows)
        again, has2 = L.bundles(texts)
        assert np.array_equal(whole, again) and np.array_equal(has, has2)


def test_prototypes_and_labels_match_brute_force(spark):
    docs = [r for r in messy(spark).collect()]
    sums = {}
    for r in docs:
        if r.lang is not None:
            sums[r.lang] = sums.get(r.lang, 0) + brute_vector(r.text)
    learned = L.learn(messy(spark))
    for lang, v in sums.items():
        assert np.allclose(learned[lang], v / np.linalg.norm(v))
    names = sorted(sums)
    for r in L.predict(messy(spark), learned, ["text"]).collect():
        v = brute_vector(r.doc.text)
        if v.any():
            cosine = [v @ learned[n] / np.linalg.norm(v) for n in names]
            assert r.lang_pred == names[int(np.argmax(cosine))] and abs(r.score - max(0, max(cosine))) < 1e-6


def test_long_text_of_many_letters_stays_small():
    """Two million characters of varied CJK: nearly every trigram differs."""
    import subprocess
    import sys
    code = ("import resource, numpy as np\n"
            "from cosignal.llm import langid as L\n"
            "t = ''.join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FA5, 2_000_000)))\n"
            "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
            "L.bundles([t])\n"
            "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)\n")
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert used < 700


def test_letter_vectors_are_nearly_orthogonal():
    v = L.letter_vectors(np.arange(97, 123))
    gram = np.abs(v @ v.T / L.DIM - np.eye(26))
    assert gram.max() < 0.25 and set(np.unique(v)) == {-1.0, 1.0}


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_language_id(spark, sf).collect()
    assert len(got) == len(langs) and all(0 <= r.score <= 1 for r in got)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)


def test_awkward_rows(spark):
    docs = messy(spark)
    prototypes = L.learn(docs)
    assert set(prototypes) == {"en", "de"}
    got = L.predict(docs, prototypes, docs.columns).collect()
    assert len(got) == docs.count()
    for r in got:
        lettered = any(c.isalpha() for c in r.doc.text or "")
        assert (r.lang_pred == "und") == (not lettered) and (lettered or r.score == 0)
    assert L.learn(empty(spark)) == {}
    assert {r.lang_pred for r in L.predict(docs, {}).collect()} == {"und"}
    assert L.predict(empty(spark), prototypes).count() == 0
