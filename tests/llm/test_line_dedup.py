from collections import defaultdict

from pyspark.sql import functions as F

from cosignal.llm import line_dedup as L
from cosignal.llm.common import BLANKS

from .helpers import empty, messy


def brute(rows, min_sites):
    """rows: (doc_id, text, site) -> cleaned text, lines, removed, in order."""
    sites, home = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            k = line.strip(BLANKS)
            if k:
                if site is not None:
                    sites[k].add(site)
                home.setdefault(k, None)
                if i is not None and (home[k] is None or i < home[k]):
                    home[k] = i
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((None, 0, 0))
            continue
        lines = text.split("\n")
        keep = [x for x in lines if not (x.strip(BLANKS) and len(sites[x.strip(BLANKS)]) >= min_sites
                                         and home[x.strip(BLANKS)] != i)]
        out.append(("\n".join(keep), sum(bool(x.strip(BLANKS)) for x in lines), len(lines) - len(keep)))
    return out


def test_awkward_rows(spark):
    docs = messy(spark)
    rows = docs.collect()
    for least in (2, 6):
        got = L.clean(docs, min_sites=least).collect()
        want = brute([(r.doc_id, r.text, r.source) for r in rows], least)
        key = lambda t: str(t)
        assert (sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got], key=key)
                == sorted([(r.doc_id, *w) for r, w in zip(rows, want)], key=key))
        kept = L.clean_documents(docs, min_sites=least)
        assert kept.columns == docs.columns and kept.schema["n_chars"] == docs.schema["n_chars"]
        assert all(r.n_chars == len(r.text) for r in kept.filter("text IS NOT NULL").collect())
    assert L.clean(empty(spark)).count() == 0 and L.clean_documents(empty(spark)).count() == 0


def test_far_and_near_lines(spark):
    """Spreads from 1 to 40 sites: estimates decide far lines, counts the near ones."""
    rows = [(1000 * s + i, f"line {s}\nown {s} {i}", f"site{i}") for s in range(1, 41) for i in range(s)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (5, 20):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in L.clean(df, min_sites=least).collect()}
        assert [got[i] for i, _, _ in rows] == brute(rows, least)


def test_one_line_everywhere_and_many_times(spark):
    rows = [(i, "hot\nhot\n" + f"own {i}", f"s{i % 9}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = L.clean(df)
    assert got.agg(F.sum("n_removed")).first()[0] == 2 * 499
    assert got.filter("doc_id = 0").first().text == "hot\nhot\nown 0"
