import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cosignal.functions.names import clean_name
from cosignal.sources.reports import complete_quarters, read_delimited, read_quarters

LINES = [
    b"primaryid$drug_seq$drugname",
    b"1$1$asp\xe9rin-81",
    b"1$2$foo$extra",
    b"2$1",
    b'3$1$ab"c',
    b"4$1$NA", b"4$2$None", b"4$3$null",
    b"5$1$x\xa0y",
    b"6$1$",
    b'7$1$"q r"',
    b'8$1$"open q',
    b"9$1$zz",
    b"10$1$t$",
    b"11$1$u$$junk",
]


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\n".join(lines) + b"\n")


def test_parser_fixture(spark):
    d = tempfile.mkdtemp(prefix="cosignal-reader-")
    path = os.path.join(d, "DRUG25Q1.txt")
    _write(path, LINES)
    df = read_delimited(spark, path)
    assert df.columns == ["PRIMARYID", "DRUG_SEQ", "DRUGNAME"]
    from cosignal.sources.reports import na_to_null
    rows = (df.select(F.col("PRIMARYID").cast("long").alias("id"),
                      clean_name(na_to_null(F.col("DRUGNAME"))).alias("c"))
            .orderBy("id", "c").collect())
    got = [(r.id, r.c) for r in rows]
    assert got == [(1, "ASP\xc9RIN81"), (2, ""), (3, "ABC"), (4, ""), (4, ""), (4, ""), (5, "X Y"),
                   (6, ""), (7, "Q R"), (8, "OPEN Q"), (9, "ZZ"), (10, "T")]
    # a pruned select sees the same lines as a full count
    assert df.select("PRIMARYID").count() == df.count() == 12


def test_read_quarters_skips_incomplete(spark):
    base = tempfile.mkdtemp(prefix="cosignal-quarters-")
    q1 = os.path.join(base, "2025q1", "ASCII")
    _write(os.path.join(q1, "DEMO25Q1.txt"), [b"primaryid$caseid$age$sex", b"1$9$70$M", b"2$9$NA$F"])
    _write(os.path.join(q1, "DRUG25Q1.txt"), [b"primaryid$drugname", b"1$aspirin", b"1$warfarin"])
    _write(os.path.join(q1, "REAC25Q1.txt"), [b"primaryid$pt", b"1$Bleeding"])
    q2 = os.path.join(base, "2025q2", "ASCII")
    _write(os.path.join(q2, "DEMO25Q2.txt"), [b"primaryid$age$sex", b"5$1$M"])
    _write(os.path.join(q2, "DRUG25Q2.txt"), [b"primaryid$drugname", b"5$x"])
    rep = read_quarters(spark, base, ["2025q1", "2025q2", "2025q3"])
    demo = sorted(tuple(r) for r in rep.demo.collect())
    assert demo == [("2025q1", 1, 70.0, "M"), ("2025q1", 2, None, "F")]
    assert rep.drug.count() == 2 and rep.reac.count() == 1
    assert rep.drug.schema["PRIMARYID"].dataType.simpleString() == "bigint"


def test_read_quarters_mixed_headers_and_discovery(spark):
    base = tempfile.mkdtemp(prefix="cosignal-mixed-")
    for q, demo_header, demo_row in (("2024q4", b"primaryid$age$sex", b"7$40$F"),
                                     ("2025q1", b"sex$PRIMARYID$age", b"M$8$50")):
        d = os.path.join(base, q, "ASCII")
        _write(os.path.join(d, f"DEMO{q}.txt"), [demo_header, demo_row])
        _write(os.path.join(d, f"DRUG{q}.txt"), [b"primaryid$drugname", demo_row[:0] + b"1$a"])
        _write(os.path.join(d, f"REAC{q}.txt"), [b"primaryid$pt", b"1$x"])
    rep = read_quarters(spark, base)          # quarters discovered from the folder names
    demo = sorted(tuple(r) for r in rep.demo.collect())
    assert demo == [("2024q4", 7, 40.0, "F"), ("2025q1", 8, 50.0, "M")]
    assert sorted(r.quarter for r in rep.drug.collect()) == ["2024q4", "2025q1"]


def test_files_of_one_quarter_with_different_headers(spark):
    base = tempfile.mkdtemp(prefix="cosignal-headers-")
    d = os.path.join(base, "2025q1", "ASCII")
    _write(os.path.join(d, "DEMO1.txt"), [b"primaryid$age$sex", b"7$40$F"])
    _write(os.path.join(d, "DRUG1.txt"), [b"primaryid$drugname", b"7$alpha"])
    _write(os.path.join(d, "DRUG2.txt"), [b"drugname$primaryid", b"beta$7"])
    _write(os.path.join(d, "REAC1.txt"), [b"primaryid$pt", b"7$x"])
    rep = read_quarters(spark, base)
    assert sorted((r.PRIMARYID, r.DRUGNAME) for r in rep.drug.collect()) == [(7, "alpha"), (7, "beta")]


def test_incomplete_quarters_are_reported(spark):
    base = tempfile.mkdtemp(prefix="cosignal-incomplete-")
    for q, kinds in (("2025q1", ("DEMO", "DRUG", "REAC")), ("2025q2", ("DEMO", "DRUG"))):
        for kind in kinds:
            _write(os.path.join(base, q, "ASCII", f"{kind}1.txt"), [b"primaryid$age$sex$drugname$pt", b"1$2$F$a$b"])
    assert complete_quarters(spark, base, ["2025q1", "2025q2"]) == (["2025q1"], {"2025q2": ["REAC"]})
    with pytest.warns(UserWarning, match="2025q2"):
        assert {r.quarter for r in read_quarters(spark, base).demo.collect()} == {"2025q1"}
    with pytest.raises(FileNotFoundError, match="REAC"):
        read_quarters(spark, base, require_complete=True)


def test_gzip_report_file(spark):
    import gzip
    d = tempfile.mkdtemp(prefix="cosignal-gz-")
    with gzip.open(os.path.join(d, "DRUG25Q1.txt.gz"), "wb") as f:
        f.write(b"primaryid$drugname\n1$asp\xe9rin\n2$x$y\n")
    df = read_delimited(spark, os.path.join(d, "DRUG25Q1.txt.gz"))
    assert df.columns == ["PRIMARYID", "DRUGNAME"]
    assert [tuple(r) for r in df.collect()] == [("1", "asp\xe9rin")]
