"""Score a table of drug pairs from the artefacts of a build; nothing is fitted here.

    python -m cosignal.plans.score --artefacts /data/signals --pairs /data/pairs \\
        --out /data/scores [--mode upper_trim] [--top 10]

``--pairs`` is a Parquet table with drug_a, drug_b (raw names; request_id is kept if
present), or ``examples`` for the literal quick-start pairs. Three tables are written:
``scores`` (nested records), ``report`` (flat, with composite, advice and agreement) and
``json`` (one document a pair).
"""

from __future__ import annotations

import argparse

from cosignal.operators import score as SC
from cosignal.plans.build import artefacts
from cosignal.session import drop_scratch, get_spark
from cosignal.sources import tables as T


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--artefacts", required=True)
    ap.add_argument("--pairs", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--mode", default="clean", choices=["clean", "upper_trim"])
    ap.add_argument("--top", type=int, default=10)
    a = ap.parse_args()
    spark = get_spark(profile="cluster")
    pairs = T.example_pairs(spark) if a.pairs == "examples" else spark.read.parquet(a.pairs)
    out = a.out.rstrip("/")
    scored = SC.score_stored(pairs, artefacts(a.artefacts.rstrip("/")), a.top, a.mode)
    T.write_table(scored, f"{out}/scores")
    stored = spark.read.parquet(f"{out}/scores")
    T.write_table(SC.score_report(stored), f"{out}/report")
    T.write_table(SC.score_json(stored), f"{out}/json")
    drop_scratch(spark)


if __name__ == "__main__":
    main()
