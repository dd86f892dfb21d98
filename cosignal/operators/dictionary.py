"""Dictionary ids: drug and event names as dense integers.

Distinct raw drug names are cleaned once each, and clean drug names and event names are
numbered, drugs before events and each kind in name order, so comparing two drug ids compares
the names. Report rows carry ids from their first shuffle on; names come back after the support
filter. Encoding and decoding are joins without a hint: adaptive execution broadcasts the
dictionary when its measured size allows and shuffles otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosignal.functions.names import normalise
from cosignal.operators.graph import ROWS_PER_RANGE, dense_index
from cosignal.operators.pairs import DRUG, EVENT
from cosignal.session import cut_lineage
from cosignal.sources.reports import Reports

@dataclass
class Dictionary:
    raw: DataFrame       # kind, raw, name, id: several raw drug names may share a name
    drugs: DataFrame     # drug, id
    events: DataFrame    # event, id


def build_dictionary(rep: Reports, mode: str = "clean") -> Dictionary:
    """Ids of all non-empty cleaned drug names and all non-null event names of the reports."""
    drugs = rep.drug.select(F.lit(DRUG).alias("kind"), F.col("DRUGNAME").alias("raw"))
    events = rep.reac.select(F.lit(EVENT).alias("kind"), F.col("PT").alias("raw"))
    # Stored before they are cleaned: the filter on the clean name would run below the distinct
    # otherwise, on every row.
    found = cut_lineage(drugs.unionByName(events).filter("raw IS NOT NULL").distinct(), "found-names")
    clean = F.when(F.col("kind") == DRUG, normalise("raw", mode)).otherwise(F.col("raw"))
    found = cut_lineage(found.withColumn("name", clean).filter((F.col("kind") == EVENT) | (F.col("name") != "")), "names")
    ranges = -(-found.count() // ROWS_PER_RANGE)             # raw names are no fewer than names
    ids = dense_index(found.select("kind", "name").distinct(), ["kind", "name"], "id", ranges)
    ids = ids.select("kind", "name", F.col("id").cast("int").alias("id"))
    # Stored, so that the planner knows the size: a small dictionary is broadcast to the report
    # rows, which are never shuffled by name then.
    raw = cut_lineage(found.join(ids, ["kind", "name"]), "raw-names")
    ids = cut_lineage(ids, "name-ids") if ranges > 1 else ids
    return Dictionary(raw=raw,
                      drugs=ids.filter(F.col("kind") == DRUG).select(F.col("name").alias("drug"), "id"),
                      events=ids.filter(F.col("kind") == EVENT).select(F.col("name").alias("event"), "id"))


def encode_drugs(rep: Reports, d: Dictionary) -> DataFrame:
    """quarter, PRIMARYID, drug (id); rows without report number or name drop out."""
    ids = d.raw.filter(F.col("kind") == DRUG).select(F.col("raw").alias("DRUGNAME"), F.col("id").alias("drug"))
    return rep.drug.filter(F.col("PRIMARYID").isNotNull()).join(ids, "DRUGNAME").select("quarter", "PRIMARYID", "drug")


def encode_events(rep: Reports, d: Dictionary) -> DataFrame:
    """quarter, PRIMARYID, event (id; null stays null)."""
    return (rep.reac.filter(F.col("PRIMARYID").isNotNull())
            .select("quarter", "PRIMARYID", F.col("PT").alias("event"))
            .join(d.events, "event", "left").select("quarter", "PRIMARYID", F.col("id").alias("event")))


def decode(df: DataFrame, d: Dictionary) -> DataFrame:
    """Names in place of ids, in whichever of drug_a, drug_b and event ``df`` has."""
    for c in ("drug_a", "drug_b", "event"):
        if c in df.columns:
            names = (d.events if c == "event" else d.drugs).select(
                F.col("id").alias(c), F.col("event" if c == "event" else "drug").alias("_name"))
            # A null event has no id; every other id is in the dictionary.
            joined = df.join(names, c, "left" if c == "event" else "inner")
            df = joined.select(*[F.col("_name").alias(x) if x == c else F.col(x) for x in df.columns])
    return df
