import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cosignal.llm import simhash as S
from cosignal.llm.queries import op6_simhash

from .helpers import SF, empty, messy, words


def brute_fp(text, n=4):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), seed=42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(fps, tau=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(rows, texts):
    """rows: (doc_id, fp unsigned, component) in the order of texts: (doc_id, text)."""
    fps = [brute_fp(t) for _, t in texts]
    comp = brute_components(fps)
    least = {}
    for (i, _), c in zip(texts, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i is None, i or 0), f, least.get(c, -1)) for (i, _), f, c in zip(texts, fps, comp))
    got = sorted(((r[0] is None, r[0] or 0), r[1], -1 if r[2] is None else r[2]) for r in rows)
    assert got == want


def test_query_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op6_simhash(spark, SF).collect()], texts)


def test_awkward_rows(spark):
    docs = messy(spark)
    got = S.near_duplicates(docs).collect()
    check([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], [(r.doc_id, r.text) for r in docs.collect()])
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 7, 9} <= set(ids) and 2 not in ids
    assert S.near_duplicates(empty(spark)).count() == 0 and S.keep_first(empty(spark)).count() == 0


def test_rows_without_ids(spark):
    rows = [(None, "alpha beta gamma delta epsilon"), (None, "alpha beta gamma delta epsilon"), (5, None),
            (None, "one two three four five six seven eight")]
    kept = S.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((i or 0, t or "") for i, t in set(rows))


@pytest.mark.parametrize("limit", [4, 4096])
def test_links_of_crowded_fingerprints(spark, limit):
    """Many fingerprints around few centres, in small blocks too."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-2**63, 2**63 - 1, 6)
    fps = {int(c) for c in centres} | {0}
    for _ in range(400):
        x = np.int64(rng.choice(centres))
        for b in rng.choice(64, rng.integers(1, 8), replace=False):
            x ^= np.int64(np.uint64(1) << np.uint64(b))
        fps.add(int(x))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.node: r.root for r in S.components(S.links(df, S.plan(df), limit=limit)).collect()}
    comp = brute_components([f % 2**64 for f in fps])
    assert [found.get(f, f) for f in fps] == [fps[c] for c in comp]


def test_allocation_is_the_best_sum():
    rng = np.random.default_rng(0)
    for m in (2, 3, 4):
        costs = [sorted(rng.integers(0, 1000, 6).tolist()) for _ in range(m)]
        cost, chosen = S.allocate(costs, 4)
        assert sum(chosen) == 4 - m + 1
        import itertools
        best = min(sum(c[t] for c, t in zip(costs, ts)) for ts in itertools.product(range(6), repeat=m) if sum(ts) == 5)
        assert cost == best


def test_every_distance_has_an_exact_plan_or_a_clear_error():
    """All pairs within tau of a small set differ by at most t_i bits in some part."""
    rng = np.random.default_rng(7)
    base = rng.integers(-2 ** 63, 2 ** 63, 60)
    near = [b ^ np.int64(sum(1 << int(i) for i in rng.choice(62, k, replace=False))) for b in base for k in (1, 4, 9, 16)]
    fps = np.unique(np.concatenate([base, near]))
    bit = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int)
    apart = (bit[:, None, :] != bit[None, :, :])
    for tau in range(17):
        plan = S.make_plan(fps, 10 ** 6, tau)
        assert sorted(b for p in plan.parts for b in p) == list(range(64))
        assert sum(plan.thresholds) == tau - len(plan.parts) + 1
        hit = np.zeros(apart.shape[:2], bool)
        for p, t in zip(plan.parts, plan.thresholds):
            hit |= apart[:, :, list(p)].sum(2) <= t
        assert hit[apart.sum(2) <= tau].all()
    for bad in (-1, 64):
        with pytest.raises(ValueError, match="tau"):
            S.make_plan(fps, 100, bad)
    with pytest.raises(ValueError, match="no plan"):
        S.make_plan(fps, 100, 60, m=2)


def test_few_parts_for_many_fingerprints():
    """Chance pairs per fingerprint stay bounded as the table grows."""
    fps = np.unique(np.random.default_rng(8).integers(-2 ** 63, 2 ** 63, 2048))
    counts = [len(S.make_plan(fps, n).parts) for n in (10 ** 4, 10 ** 6, 10 ** 8, 10 ** 10)]
    assert counts[:2] == [3, 3] and counts[-1] == 2


def test_any_plan_is_exact(spark):
    fps = [r.fp for r in S.near_duplicates(messy(spark)).select("fp").distinct().collect()]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    parts = tuple(tuple(range(i * 16, i * 16 + 16)) for i in range(4))
    want = None
    for thresholds in ((1, 0, 0, 0), (-1, 1, 1, 0), (2, 1, -1, -1)):
        got = sorted(S.components(S.links(df, S.Plan(parts, thresholds))).collect())
        want = want or got
        assert got == want
    assert df.filter(F.col("fp") == 0).count() == 1


def test_rows_that_share_an_id(spark):
    """Every component keeps one row, whatever the order of the rows."""
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six seven eight",
                  "red orange yellow green blue indigo violet", "Red Orange yellow green blue indigo violet")
    rows = [(7, a), (7, b), (3, c), (7, c), (8, "north east south west"), (8, "north east south west"), (9, d), (11, b)]
    comp = brute_components([brute_fp(t) for _, t in rows])
    assert len(set(comp)) == 4
    for some in (rows, rows[::-1], rows * 2):
        kept = S.keep_first(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect()
        assert sorted(map(tuple, kept)) == sorted([(7, a), (7, b), (3, c), (8, "north east south west")])
    # Equal fingerprints, different texts: always the same row.
    same = [(9, c), (9, d)]
    for some in (same, same[::-1]):
        assert [tuple(r) for r in S.keep_first(spark.createDataFrame(some, "doc_id long, text string")).collect()] == [(9, d)]
