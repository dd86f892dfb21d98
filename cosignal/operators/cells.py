"""The pair explosion over cells: bounded pieces of reports, stored once.

A report's distinct drugs are sorted and cut into chunks of ``cell_drugs``, its facts (one per
event: id and weight) into slices. A cell is two chunks (the first not after the second) and a
slice, so every (pair, fact) of a report lies in exactly one cell, and a cell yields at most
about ``cell_rows`` rows however large its report is. Ordinary reports are one cell.

Cells are stored; each pass over them (sketch, counts, totals) deals them to tasks by a hash of
the cell and explodes them inside the task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cosignal.operators.dictionary import Dictionary, encode_drugs, encode_events
from cosignal.operators.pairs import DEMO, DRUG, EVENT, ORDER, ROWS_PER_TASK, of_report, pieces, sorted_rows
from cosignal.session import collecting, cut_lineage
from cosignal.sources.reports import Reports

REPORT = ["quarter", "PRIMARYID"]
CELL_DRUGS = 64
CELL_ROWS = 1_000_000


def coded_reports(rep: Reports, d: Dictionary) -> DataFrame:
    """quarter, PRIMARYID, ds, fs, m: the distinct drug ids in order, (event, reaction rows), and
    the number of demographic rows of each report.

    The three tables share one shuffle (``sorted_rows``), and equal rows are merged before they
    are collected, so the arrays are bounded by the dictionary, not by the data.
    """
    key = [F.col(c) for c in REPORT]
    rows = (encode_drugs(rep, d).select(*key, F.lit(DRUG).alias("kind"), F.col("drug").alias("id"))
            .unionByName(encode_events(rep, d).select(*key, F.lit(EVENT).alias("kind"), F.col("event").alias("id")))
            .unionByName(rep.demo.filter(F.col("PRIMARYID").isNotNull())
                         .select(*key, F.lit(DEMO).alias("kind"), F.lit(None).cast("int").alias("id"))))
    return (sorted_rows(rep, rows, "kind", "id").groupBy(*ORDER)
            .agg(F.collect_list(of_report(DRUG, F.col("id"))).alias("ds"),
                 F.collect_list(of_report(EVENT, F.struct(F.col("id").alias("event"), F.col("n").alias("w")))).alias("fs"),
                 F.max(of_report(DEMO, F.col("n"))).alias("m"))
            .filter((F.size("ds") >= 2) & (F.size("fs") > 0) & F.col("m").isNotNull())
            .withColumn("ds", F.sort_array("ds")))


def report_cells(rep: Reports, d: Dictionary, cell_drugs: int = CELL_DRUGS,
                 cell_rows: int = CELL_ROWS) -> DataFrame:
    """quarter, cell, da, db, fs, m, pairs, rows: all cells that yield a row. ``cell`` is a hash
    to deal them by, ``pairs`` and ``rows`` how many pairs and rows they yield."""
    slice_size = max(1, 2 * cell_rows // (cell_drugs * cell_drugs))
    chunked = coded_reports(rep, d).select(*REPORT, "m", "fs", pieces("ds", cell_drugs).alias("chunks"))
    sides = (chunked.select(*REPORT, "m", "fs", "chunks", F.posexplode("chunks").alias("ca", "da"))
             .select(*REPORT, "m", "fs", "ca", "da", F.posexplode("chunks").alias("cb", "db")).filter("ca <= cb")
             .select(*REPORT, "m", "ca", "cb", "da", "db", F.posexplode(pieces("fs", slice_size)).alias("slice", "fs")))
    n, k = F.size("da").cast("long"), F.size("db").cast("long")
    pairs = F.when(F.col("ca") < F.col("cb"), n * k).otherwise((n * (n - 1) / 2).cast("long"))
    return (sides.withColumn("pairs", pairs).filter("pairs > 0")
            .select("quarter", F.xxhash64(*REPORT, "ca", "cb", "slice").alias("cell"), "da", "db", "fs", "m", "pairs",
                    (F.col("pairs") * F.size("fs")).alias("rows")))


@dataclass
class Cells:
    table: DataFrame     # as report_cells, stored
    rows: int            # exploded rows of all cells


def store_cells(rep: Reports, d: Dictionary, cell_drugs: int = CELL_DRUGS, cell_rows: int = CELL_ROWS) -> Cells:
    """The cells written once; their exploded rows are counted on the way."""
    seen = Observation()
    made = report_cells(rep, d, cell_drugs, cell_rows).observe(seen, F.sum("rows").alias("rows"))
    with collecting(made.sparkSession):
        return Cells(cut_lineage(made, "cells"), seen.get["rows"] or 0)


def dealt(cells: Cells) -> DataFrame:
    """Cells over as many tasks as their rows ask for: a cell's work is its output, which
    adaptive execution cannot see."""
    n = max(cells.table.sparkSession.sparkContext.defaultParallelism, -(-cells.rows // ROWS_PER_TASK))
    return cells.table.repartition(n, "cell")


def exploded_pairs(table: DataFrame, *carry: str) -> DataFrame:
    """drug_a, drug_b (drug_a < drug_b) and the ``carry`` columns, one row per pair of a cell."""
    return (table.select(*carry, F.explode("da").alias("drug_a"), "db")
            .select(*carry, "drug_a", F.explode("db").alias("drug_b")).filter("drug_a < drug_b"))


def triples(cells: Cells, by_batch: bool = False) -> DataFrame:
    """[quarter,] drug_a, drug_b, event, w: one row per pair and event of a report; w = reaction
    rows with the event x demographic rows."""
    batch = ["quarter"] if by_batch else []
    return (exploded_pairs(dealt(cells), *batch, "m", "fs")
            .select(*batch, "drug_a", "drug_b", "m", F.explode("fs").alias("f"))
            .select(*batch, "drug_a", "drug_b", F.col("f.event").alias("event"), (F.col("f.w") * F.col("m")).alias("w")))


def weight() -> F.Column:
    """Summed weight of a cell's facts."""
    return F.aggregate("fs", F.lit(0).cast("long"), lambda s, f: s + f["w"]) * F.col("m")


def pair_totals(cells: Cells) -> DataFrame:
    """drug_a, drug_b, pair_total: a pair meets one weight per cell, not its events."""
    return (exploded_pairs(cells.table.select("da", "db", weight().alias("w")), "w")
            .groupBy("drug_a", "drug_b").agg(F.sum("w").cast("bigint").alias("pair_total")))


def event_totals(cells: Cells) -> DataFrame:
    """event, event_total: an event meets the number of pairs of its cell, not the pairs."""
    return (cells.table.select((F.col("pairs") * F.col("m")).alias("k"), F.explode("fs").alias("f"))
            .groupBy(F.col("f.event").alias("event"))
            .agg(F.sum(F.col("f.w") * F.col("k")).cast("bigint").alias("event_total")))


def grand_total(cells: Cells) -> F.Column:
    """Scalar: number of pair-event rows."""
    return cells.table.agg(F.coalesce(F.sum(F.col("pairs") * weight()), F.lit(0)).cast("bigint")).scalar()
