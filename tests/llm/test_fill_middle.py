import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cosignal.llm import fill_middle as M
from cosignal.llm.queries import op11_fill_middle

from .helpers import SF, empty, messy

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def expected(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by plain slicing of the unit list."""
    text = text or ""
    w = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(w), "plain", None, None, text
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h4 % 100 < 20:
        return len(w), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(w), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10 ** 9), st.text(st.sampled_from(list("aZ @[`{<>PSMé漢😀\n")), max_size=40))
def test_small_texts_match_slicing_and_round_trip(doc_id, text):
    raw = text.encode()
    made = M.rearrange(doc_id, raw)
    out = b"".join(M.stream(made.pieces, (raw, M.MARK_BUFFER)))
    assert (made.n, made.form, made.prefix_chars, made.middle_chars, out.decode()) == expected(doc_id, text)
    assert M.digest(made.pieces, (raw, M.MARK_BUFFER)) == hashlib.sha256(out).hexdigest()
    back = M.take_apart(out, made.form)
    assert b"".join(M.stream(back, (out, b""))) == raw


@given(st.lists(st.integers(0, 9), min_size=1, max_size=5), st.integers(0, 60))
def test_cut_keeps_the_text(lengths, at):
    pieces = [M.Piece(M.TEXT, 10 * i, n) for i, n in enumerate(lengths)]
    made = M.cut(pieces, at)
    spell = lambda ps: [p.start + k for p in ps for k in range(p.length)]
    assert spell(made) == spell(pieces)
    if at <= sum(lengths):
        assert at in [sum(p.length for p in made[:i]) for i in range(len(made) + 1)]


def test_inverse_permutation():
    for order in M.ORDERS.values():
        assert M.inverse(M.inverse(order)) == order
        assert M.arrange(M.arrange(list("abcdef"), order), M.inverse(order)) == list("abcdef")


def test_unit_places_cross_blocks(monkeypatch):
    text = ("word é 漢 " * 50).encode()
    starts = [len(text[:m.start()]) for m in re.finditer(rb"[A-Za-z]+|[\x00-\x7f\xc0-\xff]", text)] + [len(text)]
    monkeypatch.setattr(M, "BLOCK", 7)
    small = M.Units(text)
    assert small.n == len(UNIT.findall(text.decode()))
    assert [small.offset(i) for i in range(small.n + 1)] == starts


def test_awkward_rows(spark):
    docs = messy(spark)
    extra = spark.createDataFrame([(21, "a<P>b"), (22, "<S>"), (23, "tail <M"), (24, "x" * 3_000_000), (25, "é " * 900_000)],
                                  "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    made = M.transform(docs).cache()
    got = made.collect()
    assert len(got) == docs.count()
    for r in got:
        n, form, pre, mid, out = expected(r.doc.doc_id, r.doc.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, pre, mid, out)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        buffers = ((r.doc.text or "").encode(), M.MARK_BUFFER)
        pieces = [M.Piece(*p) for p in r.pieces]
        assert b"".join(M.stream(pieces, buffers)).decode() == out
    back = M.restore(made.select("doc", "output", "form"), ["doc"]).collect()
    for r in back:
        assert r.text == (r.doc.text or "") and r.restored_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert M.transform(empty(spark)).count() == 0
    assert M.restore(M.transform(empty(spark)), ["doc"]).count() == 0


@pytest.mark.parametrize("rates, forms", [(M.Rates(transformed=0), {"plain"}), (M.Rates(transformed=100, spm=100), {"spm"}),
                                          (M.Rates(transformed=100, spm=0), {"psm"})])
def test_rates(rates, forms):
    assert {M.rearrange(i, b"some words here", rates).form for i in range(200)} == forms


def test_query_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_fill_middle(spark, SF).collect()
    assert len(got) == len(texts) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        n, form, pre, mid, out = expected(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, pre, mid)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
