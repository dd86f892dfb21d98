import re
import string

from pyspark.sql import functions as F

from cosignal.functions.names import PUNCTUATION, canonical_pair, clean_name, upper_trim


def py_clean(name):
    if name is None:
        return ""
    name = str(name).upper()
    name = name.translate(str.maketrans("", "", string.punctuation))
    return re.sub(r"\s+", " ", name).strip()


CASES = ["aspirin", "Asp\xe9rin-81", "straße µ", "a \x85b", "a\x1c\x1fb", "a-spirin", "", "   ",
         "x\xa0y", "  Warfarin  Sodium. ", "ab\"c", "q r　s", "a\tb\nc", "(5-FU)/leucovorin",
         "PARACETAMOL;CODEINE", "Ñandú été", None]


def test_punctuation_is_python_set():
    assert PUNCTUATION == string.punctuation


def test_clean_matches_python(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "x string")
    got = [r[0] for r in df.select(clean_name("x")).collect()]
    assert got == [py_clean(c) for c in CASES]


def test_fixture_cleaner_cases(spark):
    df = spark.createDataFrame([("straße µ",), ("a \x85b",), ("a\x1c\x1fb",), ("a-spirin",), ("",), (None,)], "x string")
    got = [r[0] for r in df.select(clean_name("x")).collect()]
    assert got == ["STRASSE Μ", "A B", "A B", "ASPIRIN", "", ""]


def test_canonical_pair_and_upper_trim(spark):
    df = spark.createDataFrame([("warfarin ", " Aspirin"), ("b", "a")], "a string, b string")
    a, b = canonical_pair("a", "b")
    assert [tuple(r) for r in df.select(a, b).collect()] == [("ASPIRIN", "WARFARIN"), ("A", "B")]
    a, b = canonical_pair("a", "b", mode="upper_trim")
    assert [tuple(r) for r in df.select(a, b).collect()] == [("ASPIRIN", "WARFARIN"), ("A", "B")]
    got = spark.createDataFrame([(" x-y ",)], "x string").select(upper_trim("x")).first()[0]
    assert got == "X-Y"


def test_plain_names_take_the_short_way(spark):
    names = ["a b", "A1", "a  b", "ab\n", "\nab", "a\tb", " a", "a ", "", " ", "a-b", "é 1", "ß", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(clean_name("n").alias("c")).collect()
    assert [r.c for r in got] == ["A B", "A1", "A B", "AB", "AB", "A B", "A", "A", "", "", "AB", "É 1", "SS", ""]
