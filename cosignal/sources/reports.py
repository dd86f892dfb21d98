"""Report files: `$`-delimited latin-1 text with a header, one folder per quarter.

Three kinds are read: demographics (PRIMARYID, AGE, SEX), drugs (PRIMARYID, DRUGNAME)
and reactions (PRIMARYID, PT). Each quarter is a batch; the same PRIMARYID in two
quarters is two different reports.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosignal.session import cut_lineage

# Strings that the reports' original reader turns into a missing value
# (pandas' default NA list), in natural order.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# File name prefixes and the columns kept for each kind.
KINDS = {
    "demo": ("DEMO", ["PRIMARYID", "AGE", "SEX"]),
    "drug": ("DRUG", ["PRIMARYID", "DRUGNAME"]),
    "reac": ("REAC", ["PRIMARYID", "PT"]),
}

# Two more columns than the header: the first takes a trailing separator, the second shows
# that a line has too many fields.
EXTRA_COLS = ["_extra_1", "_extra_2"]

DEMO_SCHEMA = "quarter string, PRIMARYID bigint, AGE double, SEX string"
DRUG_SCHEMA = "quarter string, PRIMARYID bigint, DRUGNAME string"
REAC_SCHEMA = "quarter string, PRIMARYID bigint, PT string"


@dataclass
class Reports:
    """The three report tables of one or more quarters, each with a ``quarter`` column."""
    demo: DataFrame
    drug: DataFrame
    reac: DataFrame


def na_to_null(c: Column) -> Column:
    return F.when(c.isin(NA_STRINGS), F.lit(None).cast("string")).otherwise(c)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _data_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files matched by a glob; a matched folder contributes the files inside it."""
    jvm, p, fs = _hadoop(spark, pattern)
    out = []
    for st in fs.globStatus(p) or []:
        sts = fs.listStatus(st.getPath()) if st.isDirectory() else [st]
        out += [x.getPath().toString() for x in sts
                if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    """Column names from the first line of the first file matched (read directly, no job)."""
    files = _data_files(spark, path)
    return _file_header(spark, files[0], sep, encoding) if files else []


def _file_header(spark: SparkSession, file: str, sep: str, encoding: str) -> list[str]:
    jvm, p, fs = _hadoop(spark, file)
    stream = fs.open(p)
    # Compressed files (.gz, .bz2, ...) are read through their codec, as Spark does.
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
    if codec is not None:
        stream = codec.createInputStream(stream)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding))
    try:
        line = reader.readLine() or ""
    finally:
        reader.close()
    return [c.strip().strip('"') for c in line.rstrip("\r").split(sep)]


def read_delimited(spark: SparkSession, path, sep: str = "$",
                   encoding: str = "ISO-8859-1", header: list[str] | None = None) -> DataFrame:
    """Scan a delimited file with a header; every column is a string, names upper-cased.

    Line rules of the original reader: a line with more fields than the header is
    skipped, a line with fewer fields is kept and padded with nulls; one trailing
    separator is no field. Two extra trailing columns in the schema make these rules hold
    whatever columns a query later prunes to. Quotes are honoured within one line only. ``path`` may be a list of
    paths that share one header.
    """
    first = path[0] if isinstance(path, (list, tuple)) else path
    cols = [c.upper() for c in (header or _header(spark, first, sep, encoding))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols]
                          + [T.StructField(c, T.StringType()) for c in EXTRA_COLS])
    df = (spark.read.schema(schema)
          .option("header", True).option("sep", sep).option("encoding", encoding)
          .option("mode", "PERMISSIVE").option("multiLine", False)
          .option("nullValue", "\u0000").option("emptyValue", "")
          .csv(path))
    first, second = map(F.col, EXTRA_COLS)
    return df.filter(second.isNull() & (first.isNull() | (first == ""))).drop(*EXTRA_COLS)


def _typed(kind: str, df: DataFrame, quarter) -> DataFrame:
    _, keep = KINDS[kind]
    cols = {c: na_to_null(F.col(c)) for c in keep}
    q = F.lit(quarter) if isinstance(quarter, str) else quarter
    out = df.select(q.alias("quarter"),
                    cols["PRIMARYID"].try_cast("bigint").alias("PRIMARYID"),
                    *[(cols[c].try_cast("double") if c == "AGE" else cols[c]).alias(c)
                      for c in keep[1:]])
    return out


# Where a kind's files sit: base folder, quarter folder, then the kind's file prefix.
DEFAULT_LAYOUT = "{base}/{quarter}/ASCII/{prefix}*.txt"


def _kind_glob(base: str, quarter: str, prefix: str, layout: str = DEFAULT_LAYOUT) -> str:
    return layout.format(base=base.rstrip("/"), quarter=quarter, prefix=prefix)


def discover_quarters(spark: SparkSession, base: str) -> list[str]:
    """Names of the quarter folders under ``base`` (a directory listing, sorted)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory())


def complete_quarters(spark: SparkSession, base: str, quarters: list[str],
                      layout: str = DEFAULT_LAYOUT) -> tuple[list[str], dict[str, list[str]]]:
    """(quarters with files of all three kinds, {other quarter: file prefixes it lacks})."""
    found, skipped = [], {}
    for q in quarters:
        lacking = [prefix for prefix, _ in KINDS.values()
                   if not _data_files(spark, _kind_glob(base, q, prefix, layout))]
        if lacking:
            skipped[q] = lacking
        else:
            found.append(q)
    return found, skipped


def _quarter_regex(layout: str, prefix: str) -> str:
    """Java regex capturing the (URI-encoded) quarter folder of a file path in ``layout``."""
    suffix = layout.split("{base}", 1)[1]
    head, tail = suffix.split("{quarter}", 1)

    def lit(x: str) -> str:
        return re.escape(x.replace("{prefix}", prefix)).replace("\\*", "[^/]*")
    return lit(head) + "([^/]+)" + lit(tail) + "(/.*)?$"


def read_quarters(spark: SparkSession, base: str, quarters: list[str] | None = None,
                  sep: str = "$", encoding: str = "ISO-8859-1",
                  layout: str = DEFAULT_LAYOUT, require_complete: bool = False) -> Reports:
    """Find DEMO*/DRUG*/REAC*.txt under ``base/<quarter>/ASCII`` and read them.

    Without a quarter list, every folder under ``base`` is a quarter. A quarter whose
    folder or any of the three members is missing is skipped with a warning, as is the
    original behaviour; ``require_complete`` makes it an error. Each file is read by its
    own header: files that share a header are read in one scan, so many files cost a few
    scans (the headers are read directly, one line each, no job). The quarter of each row
    comes from its file path.
    """
    qs = quarters if quarters is not None else discover_quarters(spark, base)
    valid, skipped = complete_quarters(spark, base, qs, layout)
    if skipped:
        said = "; ".join(f"{q} (no {', '.join(kinds)})" for q, kinds in skipped.items())
        if require_complete:
            raise FileNotFoundError(f"incomplete quarters: {said}")
        warnings.warn(f"skipped incomplete quarters: {said}", stacklevel=2)
    files = {q: [f for prefix, _ in KINDS.values() for f in _data_files(spark, _kind_glob(base, q, prefix, layout))]
             for q in valid}
    return read_files(spark, base, files, layout, sep, encoding)


def kind_of(file: str, layout: str = DEFAULT_LAYOUT) -> tuple[str, str] | None:
    """(kind, URI-encoded quarter folder) of a report file's path, or None."""
    for kind, (prefix, _) in KINDS.items():
        m = re.search(_quarter_regex(layout, prefix), file)
        if m:
            return kind, m.group(1)
    return None


def quarter_of(file: str, layout: str = DEFAULT_LAYOUT) -> str | None:
    found = kind_of(file, layout)
    return unquote(found[1]) if found else None


def kinds_of(files: list[str], layout: str = DEFAULT_LAYOUT) -> set[str]:
    return {found[0] for f in files if (found := kind_of(f, layout))}


def read_files(spark: SparkSession, base: str, files: dict[str, list[str]], layout: str = DEFAULT_LAYOUT,
               sep: str = "$", encoding: str = "ISO-8859-1") -> Reports:
    """Report tables from the given files of each quarter (see ``read_quarters``)."""
    schemas = {"demo": DEMO_SCHEMA, "drug": DRUG_SCHEMA, "reac": REAC_SCHEMA}
    jvm = spark.sparkContext._jvm
    # Encoded folder name (as it appears in file paths) -> quarter name.
    enc = {jvm.java.net.URI(None, None, q, None).getRawPath(): q for q in files}
    out = {}
    for kind, (prefix, _) in KINDS.items():
        groups: dict[tuple, list[str]] = {}
        for q in files:
            for file in files[q]:
                if kinds_of([file], layout) == {kind}:
                    groups.setdefault(tuple(_file_header(spark, file, sep, encoding)), []).append(file)
        acc = spark.createDataFrame([], schemas[kind])
        for i, (header, some) in enumerate(groups.items()):
            df = read_delimited(spark, some, sep, encoding, list(header))
            names = F.create_map(*[F.lit(x) for kv in enc.items() for x in kv])
            folder = F.regexp_extract(F.col("_metadata.file_path"), _quarter_regex(layout, prefix), 1)
            typed = _typed(kind, df.withColumn("_q", names[folder]), F.col("_q"))
            acc = acc.unionByName(typed) if i else typed
        out[kind] = acc
    return Reports(**out)


def stored(rep: Reports) -> Reports:
    """The three tables stored, typed and columnar: the counters read each of them several times,
    and text would be parsed every time."""
    return Reports(demo=cut_lineage(rep.demo, "demo"), drug=cut_lineage(rep.drug, "drug"), reac=cut_lineage(rep.reac, "reac"))


def reports_from_tables(demo: DataFrame, drug: DataFrame, reac: DataFrame) -> Reports:
    """Wrap already-typed tables (Parquet, Delta, a proxy) that carry the same columns."""
    return Reports(demo=demo.select("quarter", "PRIMARYID", "AGE", "SEX"),
                   drug=drug.select("quarter", "PRIMARYID", "DRUGNAME"),
                   reac=reac.select("quarter", "PRIMARYID", "PT"))


# Layout written by ``write_quarters``: one folder per kind, one sub-folder per quarter.
TEXT_LAYOUT = "{base}/{prefix}/quarter={quarter}/*.csv"


def write_quarters(rep: Reports, base: str, sep: str = "$", encoding: str = "ISO-8859-1") -> None:
    """Write report tables as delimited text files with a header line, in
    ``TEXT_LAYOUT`` (one partitioned write per kind). Rows are rebalanced by quarter: the
    number of files follows their bytes, not the number of tasks that made the rows."""
    for kind, df in (("demo", rep.demo), ("drug", rep.drug), ("reac", rep.reac)):
        prefix, cols = KINDS[kind]
        (df.select("quarter", *cols).hint("rebalance", "quarter").write.mode("overwrite").partitionBy("quarter")
         .option("header", True).option("sep", sep).option("encoding", encoding)
         .csv(f"{base.rstrip('/')}/{prefix}"))


def written_quarters(spark: SparkSession, base: str) -> list[str]:
    """Quarters present in a ``TEXT_LAYOUT`` folder (listed from the demographics kind)."""
    names = discover_quarters(spark, f"{base.rstrip('/')}/{KINDS['demo'][0]}")
    return [n.split("=", 1)[1] for n in names if n.startswith("quarter=")]
