"""Contingency counters: pair-event, pair, event and grand totals.

All counts are over pair-event rows (pair x reaction row x demographic row of a report),
not over reports. Three plans give the same numbers:

* ``count_pair_events``: names become ids, reports become stored cells (``cells``), and every
  counter is one pass over the cells: the triples are shuffled as three integers; pair
  totals meet one weight per cell, event totals and N the number of pairs.
* ``count_frequent``: the same, with a count-min sketch that drops triples under the support
  before their shuffle (``iceberg``).
* ``count_factored``: straight from the report tables, names as keys:
  ``event_total(e) = sum_p C(k_p, 2) * r_p(e) * m_p`` and ``N = sum_p C(k_p, 2) * r_p * m_p``;
  pair totals join the pairs with one weight per report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosignal.operators import cells as CE
from cosignal.operators.dictionary import Dictionary, build_dictionary, decode
from cosignal.operators.iceberg import SketchSize, frequent
from cosignal.operators.pairs import (DEFAULT_CELL_DRUGS, DEFAULT_CELL_ROWS, REPORT,
                                      clean_drugs, explode_pairs, multi_drug_reports,
                                      merged_rows, named_drugs, parts_for, report_event_weights)
from cosignal.session import cut_lineage
from cosignal.sources.reports import Reports

PAIR = ["drug_a", "drug_b"]


@dataclass
class Counts:
    pair_event: DataFrame   # drug_a, drug_b, event, a  (null event included)
    pair: DataFrame         # drug_a, drug_b, pair_total
    event: DataFrame        # event, event_total
    n: Column               # scalar: number of pair-event rows
    coded: Counts | None = None         # the same counters over the ids of ``names``
    names: Dictionary | None = None


def named(coded: Counts, names: Dictionary) -> Counts:
    return Counts(*(decode(df, names) for df in (coded.pair_event, coded.pair, coded.event)), coded.n, coded, names)


def pair_event_counts(rep: Reports, mode: str = "clean", cell_drugs: int = CE.CELL_DRUGS,
                      by_batch: bool = False, cell_rows: int = CE.CELL_ROWS) -> DataFrame:
    """drug_a, drug_b, event, a (optionally per quarter) from the reports; the aggregation is
    over ids and partial before its shuffle, names come back after it."""
    names = build_dictionary(rep, mode)
    cells = CE.store_cells(rep, names, cell_drugs, cell_rows)
    keys = (["quarter"] if by_batch else []) + PAIR + ["event"]
    counted = CE.triples(cells, by_batch).groupBy(*keys).agg(F.sum("w").cast("bigint").alias("a"))
    return decode(counted, names)


def totals_from_pair_events(pec: DataFrame) -> Counts:
    """Derive pair totals, event totals and N from unfiltered pair-event counts."""
    pair = pec.groupBy(*PAIR).agg(F.sum("a").cast("bigint").alias("pair_total"))
    event = pec.groupBy("event").agg(F.sum("a").cast("bigint").alias("event_total"))
    n = pec.agg(F.sum("a").cast("bigint")).scalar()
    return Counts(pair_event=pec, pair=pair, event=event, n=n)


def count_cells(cells: CE.Cells, names: Dictionary, min_support: int | None = None,
                sketch: SketchSize | None = None) -> Counts:
    """All counters from stored cells. With ``min_support``, ``pair_event`` holds only
    the groups that reach it (pruned by a ``sketch`` first, if one is given); the totals are
    those of all rows either way."""
    keys, rows = PAIR + ["event"], CE.triples(cells)
    pec = (rows.groupBy(*keys).agg(F.sum("w").cast("bigint").alias("a")) if min_support is None
           else frequent(rows, keys, "w", min_support, sketch))
    return named(Counts(pec, CE.pair_totals(cells), CE.event_totals(cells), CE.grand_total(cells)), names)


def count_pair_events(rep: Reports, mode: str = "clean", cell_drugs: int = CE.CELL_DRUGS,
                      cell_rows: int = CE.CELL_ROWS) -> Counts:
    """Counters over ids: the reports are scanned and joined once, into stored cells."""
    names = build_dictionary(rep, mode)
    return count_cells(CE.store_cells(rep, names, cell_drugs, cell_rows), names)


def count_frequent(rep: Reports, min_support: int, sketch: SketchSize | None = SketchSize(),
                   mode: str = "clean") -> Counts:
    """As ``count_pair_events``, with only the pair-event groups of ``min_support`` or more."""
    names = build_dictionary(rep, mode)
    return count_cells(CE.store_cells(rep, names), names, min_support, sketch)


def count_rows(pair_events: DataFrame) -> Counts:
    """Counters from materialised pair-event rows (drug_a, drug_b, event, ...): the rows are
    scanned and shuffled once, everything else comes from the stored counts."""
    pec = pair_events.groupBy(*PAIR, "event").agg(F.count(F.lit(1)).alias("a"))
    return totals_from_pair_events(cut_lineage(pec, "pair-event-counts"))


def report_event_rows(rep: Reports, mode: str = "clean") -> DataFrame:
    """quarter, PRIMARYID, event, rows: pair-event rows of every report and event. All sides are
    dealt by report over as many tasks as the report rows ask for, so the memory of a task does not
    grow with the input."""
    parts, named = parts_for(rep), F.col("PRIMARYID").isNotNull()
    pairs = (merged_rows(rep, named_drugs(rep.drug, mode), "drug", parts=parts).groupBy(*REPORT).agg(F.count(F.lit(1)).alias("k"))
             .filter("k >= 2").select(*REPORT, (F.col("k") * (F.col("k") - 1) / 2).cast("bigint").alias("pairs")))
    demo = rep.demo.filter(named).select(*REPORT).repartition(parts, *REPORT).groupBy(*REPORT).agg(F.count(F.lit(1)).alias("m"))
    events = merged_rows(rep, rep.reac.filter(named).select(*REPORT, F.col("PT").alias("event")), "event", parts=parts)
    return (events.join(pairs.join(demo, REPORT), REPORT)
            .select(*REPORT, "event", (F.col("n") * F.col("m") * F.col("pairs")).alias("rows")))


def event_totals_factored(rep: Reports, mode: str = "clean") -> tuple[DataFrame, Column]:
    """(event, event_total) and N from sums per report, without any pair explosion."""
    rows = report_event_rows(rep, mode)
    event = rows.groupBy("event").agg(F.sum("rows").cast("bigint").alias("event_total"))
    return event, rows.agg(F.sum("rows").cast("bigint")).scalar()


def pair_totals_factored(rep: Reports, mode: str = "clean", cell_drugs: int = DEFAULT_CELL_DRUGS,
                         cell_rows: int = DEFAULT_CELL_ROWS) -> DataFrame:
    """(drug_a, drug_b, pair_total): every pair meets one weight per report, not its events."""
    drugs = clean_drugs(rep.drug, mode)
    weights = report_event_weights(rep, multi_drug_reports(drugs))
    per_report = weights.groupBy(*REPORT).agg(F.sum("w").alias("w"))
    return (explode_pairs(drugs, per_report, REPORT, cell_drugs, cell_rows)
            .groupBy(*PAIR).agg(F.sum("w").cast("bigint").alias("pair_total")))


def count_factored(rep: Reports, mode: str = "clean",
                   cell_drugs: int = DEFAULT_CELL_DRUGS) -> Counts:
    """Factored plan: event totals and N from per-report sums, no pair explosion."""
    event, n = event_totals_factored(rep, mode)
    return Counts(pair_event=pair_event_counts(rep, mode, cell_drugs),
                  pair=pair_totals_factored(rep, mode, cell_drugs), event=event, n=n)


def batch_totals(rep: Reports, mode: str = "clean") -> DataFrame:
    """Pair-event rows per quarter (the per-batch running total), without any explosion."""
    return report_event_rows(rep, mode).groupBy("quarter").agg(F.sum("rows").cast("bigint").alias("n"))
