from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as C
from cosignal.llm import line_dedup, mixing, packing, quality
from cosignal.llm.queries import tokenizer_path

from .helpers import SF, empty, messy, words
from .test_line_dedup import brute as clean_lines
from .test_mixing import brute as mix
from .test_simhash import brute_components, brute_fp


def brute_before_packing(rows):
    """rows: (doc_id, text, source) -> Counter of (doc_id, text) that reach packing."""
    good = quality.measure([None if t is None else t.encode() for _, t, _ in rows])["kept"]
    rows = [r for r, ok in zip(rows, good) if ok]
    cleaned = clean_lines(rows, line_dedup.MIN_SITES)
    rows = [(i, t, s) for (i, _, s), (t, _, gone) in zip(rows, cleaned) if not gone or words(t)]
    comp = brute_components([brute_fp(t) for _, t, _ in rows])
    first = {}
    for (i, _, _), c in zip(rows, comp):
        first[c] = min(i, first.get(c, i))
    rows = [r for r, c in zip(rows, comp) if r[0] == first[c]]
    copies, _ = mix([(i, s, len(words(t))) for i, t, s in rows], mixing.BLOCK_DOCS)
    return Counter({(i, t): copies[i, s] for i, t, s in rows})


def test_run_matches_brute_force(spark):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute_before_packing([(r.doc_id, r.text, r.source) for r in docs])
    t = Tokenizer.from_file(str(tokenizer_path()))
    size = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want}
    got = C.run(spark, SF).collect()
    tokens, loads = Counter(), defaultdict(int)
    for r in got:
        assert r.doc_tokens == size[r.doc_id]
        tokens[r.doc_id] += r.length
        loads[r.sequence_id] += r.length
    assert tokens == Counter({i: n * size[i] for (i, _), n in want.items()})
    # Copies of a document can be told apart, and each one's pieces are gapless.
    rows = defaultdict(list)
    for r in got:
        rows[r.doc_row].append((r.start, r.length, r.doc_id, r.doc_tokens))
    assert len(rows) == sum(want.values())
    for pieces in rows.values():
        pieces.sort()
        assert len({p[2] for p in pieces}) == 1
        assert [p[0] for p in pieces] == [sum(p[1] for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(p[1] for p in pieces) == pieces[0][3]
    assert max(loads.values()) <= packing.CAPACITY


def test_stages_keep_columns_and_awkward_rows(spark):
    docs = messy(spark)
    for make in (docs, empty(spark)):
        now = make
        for name, step in C.STAGES[:-1]:
            now = step(spark, now, SF)
            assert now.columns == make.columns, name
        assert C.STAGES[-1][1](spark, now, SF).count() >= 0
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing", "packing"]


def test_sequences_follow_the_permutation(spark):
    """The mixing stage's files are sorted by position, and packing takes rows as they come."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = {}
    for r in mixing.copies(docs).select("doc.doc_id", "position").collect():
        place.setdefault(r.doc_id, []).append(r.position)
    mixed = C.stage(C.mix_sources(spark, docs, SF), "mixed")
    assert mixed.columns == docs.columns and mixed.count() == sum(map(len, place.values()))
    files = defaultdict(list)
    for r in mixed.select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).collect():
        files[r.f].append((r.n, r.doc_id))
    assert files
    for rows in files.values():
        ids, at = [i for _, i in sorted(rows)], 0.0
        for i in ids:                        # some non-decreasing choice among each document's places
            at = min(p for p in place[i] if p >= at)
    unsorted = sum(any(a > b for a, b in zip(x, x[1:])) for x in ([i for _, i in sorted(r)] for r in files.values()))
    assert unsorted == len(files)            # not the table's own order
    packed = C.pack_sequences(spark, mixed, SF).select("doc_row", "doc_id").distinct().orderBy("doc_row").collect()
    seen = defaultdict(list)
    for r in packed:
        seen[r.doc_row >> 40].append(r.doc_id)
    order = [[i for _, i in sorted(r)] for r in files.values()]
    flat = {tuple(o) for o in order}
    for ids in seen.values():                # a task reads whole files (or parts of one), in their order
        at = 0
        while at < len(ids):
            whole = next((o for o in flat if tuple(ids[at:at + len(o)]) == o), None)
            assert whole is not None or any(tuple(ids[at:]) == o[k:k + len(ids) - at] for o in flat for k in range(len(o)))
            at = at + len(whole) if whole else len(ids)
