import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cosignal.llm import packing as P
from cosignal.llm.queries import op7_pack, tokenizer_path

from .helpers import SF, empty, messy


def tokenizer():
    return Tokenizer.from_file(str(tokenizer_path()))


def check(pieces, ids_of):
    """pieces: (document key, row), ids_of: key -> ids with the end id."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for key, r in pieces:
        docs[key].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(ids_of)
    for key, rows in docs.items():
        ids, at = ids_of[key], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            part = np.array(ids[at:at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.CAPACITY
    return len(sequences)


def test_query_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    t = tokenizer()
    ids = {k: [*t.encode(v or "", add_special_tokens=False).ids, P.END_ID] for k, v in texts.items()}
    n = check([(r.doc_id, r) for r in op7_pack(spark, SF).collect()], ids)
    total = sum(map(len, ids.values()))
    assert n * P.CAPACITY <= 1.1 * total


def test_awkward_rows(spark):
    docs = messy(spark).coalesce(1)
    rows = docs.collect()
    t = tokenizer()
    got = P.pack(docs, str(tokenizer_path()), docs.columns, block=4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc].append(r)
    for d in rows:
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [P.END_ID]
        copies = rows.count(d)
        assert sum(r.length for r in by[d]) == copies * len(ids)
        assert all(r.doc_tokens == len(ids) for r in by[d])
    assert P.pack(empty(spark), str(tokenizer_path())).count() == 0


TRICKY = ["a b　c\x0bd\x1ce\x85f don't I'LL x", "<|endoftext|> hi <|startoftext|> x</w>", "é ́x İstanbul ﬁ 12,5 a\u0085b c\u00a0d",
          "한글 日本語テキスト ΟΔΟΣ Σ", "", "   ", "Cafe\u0301 CAFÉ K \u212a \u2126hm", "a.b. c.. d!? .e \x01 x\x01y", "🙂🙃 ok:",
          "it's 'Tis we're I'd x'sy 3.14,15 a-b_c/d <s></w> #@!a1b2 ...''' don't've <|im_end|>"]


def test_words_give_the_library_ids():
    spec = open(tokenizer_path(), encoding="utf-8").read()
    w, t = P.Words(spec), tokenizer()
    t.encode_special_tokens = True
    for text, ids in zip(TRICKY, w([x.encode() for x in TRICKY])):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(50, 90))
def test_windows_hold_everything_within_capacity(sizes, capacity):
    sizes = np.array(sizes)
    found = P.windows(sizes, capacity)
    assert len(found) == len(sizes) and found.min() >= 0
    assert np.bincount(found, sizes).max() <= capacity


def test_differencing_balances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1000, 400)
    for k in (1, 2, 7, 50):
        load = np.bincount(P.differencing(sizes, k), sizes, minlength=k)
        assert load.sum() == sizes.sum() and load.max() - load.min() <= 0.05 * load.mean() + 1000 * (k > 40)
    # Two-way differencing by hand: 8 7 6 5 4 -> difference 2 (16 and 14).
    load = np.bincount(P.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert abs(load[0] - load[1]) == 2


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=60))
def test_any_ascii_gives_the_library_ids(text):
    assert next(WORDS([text.encode()])).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


WORDS, LIBRARY = P.Words(open(tokenizer_path(), encoding="utf-8").read()), tokenizer()
LIBRARY.encode_special_tokens = True


def test_control_strings_are_single_ids(spark):
    """The ids of a plain encode(text, add_special_tokens=False), beside ordinary texts."""
    texts = [*TRICKY, "<|endoftext|>", "a<|endoftext|>b  <|startoftext|> c", "<|ENDOFTEXT|> x <|endoftext|", None,
             "Word " * 5000 + "<|endoftext|>" + " don't" * 3000]
    t = tokenizer()
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, P.END_ID] for i, x in enumerate(texts)}
    assert 49407 in want[1] and 49406 in want[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    check([(r.doc.doc_id, r) for r in P.pack(docs, str(tokenizer_path())).collect()], want)
