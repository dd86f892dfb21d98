import random
import tempfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cosignal.operators import search as SX


def run(spark, names, queries):
    path = tempfile.mkdtemp(prefix="cosignal-search-")
    index = SX.build_index(spark.createDataFrame([(n,) for n in names], "drug string"), path)
    asked = spark.createDataFrame([(q, "x") for q in queries], "query string, gram string")
    for some in (index, SX.read_index(spark, path)):
        got = sorted((r.query, r.drug) for r in SX.search(some, asked).collect())
        want = sorted({(q, n) for q in queries if q is not None for n in names if n is not None and q.lower() in n.lower()})
        assert got == want


def test_every_length_equals_the_scan(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abAB -é") for _ in range(rng.randint(0, 14))) for _ in range(120)] + [None, "", "x", "banana", "banana"]
    queries = ["".join(rng.choice("abB -é") for _ in range(rng.randint(0, 7))) for _ in range(80)] + [None, "", "anana", "zzz", "aZb", "%", "_"]
    run(spark, names, queries)


def test_awkward_tables(spark):
    run(spark, [], ["a", ""])
    run(spark, ["a", None], [])
    run(spark, [None], [None, ""])
    run(spark, ["aaaaaaaaaa" * 200, "aaa"], ["a" * 3, "a" * 5, "a" * 1999])


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abé", max_size=8), st.integers(1, 3))
def test_grams(spark, text, size):
    got = spark.range(1).select(SX.grams(F.lit(text), size)).first()[0]
    assert got == list(dict.fromkeys(text[i:i + size] for i in range(len(text) - size + 1)))
