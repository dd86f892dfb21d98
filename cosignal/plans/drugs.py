"""The drug catalog of a build, or the names in it that hold given texts.

    python -m cosignal.plans.drugs --artefacts /data/signals --out /data/drugs
    python -m cosignal.plans.drugs --artefacts /data/signals --queries /data/queries --out /data/found

The catalog is written sorted, as one column ``drug``. ``--queries`` is a Parquet table with a
column ``query``; the output then has a row per (query, drug) whose name holds the query,
whatever the case.
"""

from __future__ import annotations

import argparse
import uuid

from cosignal.operators import report as RP
from cosignal.operators import search as SX
from cosignal.plans.build import artefacts
from cosignal.session import drop_scratch, get_spark, scratch_path
from cosignal.sources import tables as T


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--artefacts", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--queries")
    a = ap.parse_args()
    spark = get_spark(profile="cluster")
    found = RP.stored_catalog(spark, artefacts(a.artefacts.rstrip("/")))
    if a.queries:
        index = SX.build_index(found, scratch_path(spark, f"search-{uuid.uuid4().hex}"))
        found = SX.search(index, spark.read.parquet(a.queries))
    T.write_table(found, a.out)
    drop_scratch(spark)


if __name__ == "__main__":
    main()
