import hashlib
import math
from collections import Counter, defaultdict

import pytest

from cosignal.llm import mixing as M

from .helpers import empty, messy, words


def alpha_of(tokens):
    total = sum(tokens)
    p = [t / total for t in tokens]

    def entropy(a):
        w = [x ** a for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= M.TARGET_ENTROPY * math.log(len(p)) else (low, mid)
    limit = 1 - math.log(M.MAX_PASSES) / math.log(max(p) / min(p)) if max(p) / min(p) > M.MAX_PASSES else 0.0
    return min(1.0, max(low, limit))


def brute(rows, block_docs):
    """rows: (doc_id, source, tokens) -> copies of every (doc_id, source)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    tokens = {s: sum(r[2] for r in v) for s, v in by.items()}
    live = [t for t in tokens.values() if t]
    a = math.ceil(alpha_of(live) * 1e6 - 1e-4) / 1e6 if len(live) > 1 else 1.0
    power = {s: (t / sum(live)) ** a for s, t in tokens.items() if t}
    most = max((tokens[s] / power[s] for s in power), default=1)
    out = Counter()
    for s, v in by.items():
        budget = max(tokens[s], math.floor(power[s] * most + 1e-6)) if tokens[s] else 0
        passes, rest = divmod(budget, tokens[s]) if tokens[s] else (1, 0)
        key = lambda r: hashlib.md5(f"mix|{passes}|{s or ''}|{'' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: E731,B023
        sums = Counter()
        for r in v:
            sums[key(r)] += r[2]
        admitted, used = set(), 0
        for k in sorted(sums):
            used += sums[k]
            if not rest or used > rest:
                break
            admitted.add(k)
        for r in v:
            out[r[0], r[1]] += passes + (key(r) in admitted)
    return out, a


@pytest.mark.parametrize("block_docs", [1, 5, 1024])
def test_budgets_and_copies(spark, block_docs):
    sizes = {"big": 400, "mid": 90, "small": 30, None: 25}
    rows = [(i * 10 + j, s, "w " * (1 + (i * 7 + j) % 11)) for j, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(77, "blank", None), (78, "blank", " ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want, alpha = brute([(i, s, len(words(t))) for i, s, t in rows], block_docs)
    got = M.copies(df, block_docs=block_docs).collect()
    assert Counter((r.doc.doc_id, r.source) for r in got) == want
    assert all(abs(r.alpha - alpha) < 2e-6 and 0 <= r.position < 1 for r in got)
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.tokens
    share = {r.source: r.weight for r in got if r.tokens}
    total = sum(tokens.values())
    assert all(abs(tokens[s] / total - w) < 0.02 for s, w in share.items())
    assert abs(sum(share.values()) - 1) < 1e-9


def test_awkward_rows(spark):
    docs = messy(spark)
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    have, need = Counter(map(str, mixed.collect())), Counter(map(str, docs.collect()))
    assert all(have[k] >= n for k, n in need.items()) and set(have) == set(need)
    assert M.mix_documents(empty(spark)).count() == 0
    one = docs.filter("source = 'a'")
    assert sorted(map(str, M.mix_documents(one).collect())) == sorted(map(str, one.collect()))


def test_bisection(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    from pyspark.sql import functions as F
    got = M.bisect(df, lambda a: F.max(F.lit(a)) <= 0.3141592, 0.0, 1.0)
    assert 0 <= 0.3141592 - got < 1e-9
