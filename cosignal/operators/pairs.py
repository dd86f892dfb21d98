"""Reports -> canonical drug pairs -> pair-event rows and weights.

A report (quarter, PRIMARYID) with ``k`` distinct drugs yields ``k(k-1)/2`` pairs; every
pair is combined with each of the report's facts (reaction rows, or one row per event).

One plan serves reports of any size. Its unit of work is a cell: two pieces of a report's drugs
and a slice of its facts, so that every (pair, fact) lies in exactly one cell and a cell yields at
most about ``cell_rows`` rows. An ordinary report is one cell; a huge one is spread over many tasks.

* ``pair_events`` collects a report's distinct drugs, events and demographic values, cuts them
  into cells and multiplies the cells out inside the tasks; those of reports that yield many rows
  are dealt to tasks first, and cells of a small budget are cut inside the task.
* ``explode_pairs`` takes any facts table: drugs are dealt by hash over ``g`` rows on the left
  side and ``g`` columns on the right, facts over ``s`` slices; ``g`` and ``s`` follow from the
  report's product of pairs and facts. The three sides are shuffled by the cell once, and
  both joins run on that partitioning.

Everything counted per report is aggregated before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cosignal.functions.names import normalise
from cosignal.session import collecting, cut_lineage
from cosignal.sources.reports import Reports

REPORT = ["quarter", "PRIMARYID"]
ORDER = ["PRIMARYID", "quarter"]         # a report's key, the more telling part first
CELL = REPORT + ["cell_a", "cell_b", "cell_s"]
DEFAULT_CELL_DRUGS = 512
DEFAULT_CELL_ROWS = 1_000_000
DRUG, EVENT, DEMO = 0, 1, 2    # kinds of report rows
ROWS_PER_PART = 400_000        # report rows a task is meant to merge
ROWS_PER_TASK = 4_000_000      # exploded rows a task is meant to see


def parts_for(rep: Reports) -> int:
    """Tasks for the report rows: these are counted (a look at the footers of stored tables),
    because adaptive execution sees their compressed bytes only, and the memory of a task follows
    its rows."""
    rows = sum(df.count() for df in (rep.demo, rep.drug, rep.reac))
    return max(rep.drug.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PART))


def merged_rows(rep: Reports, rows: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """Equal rows (report and ``by``) once with their number ``n``, dealt by report: a
    report of any number of rows arrives there with its distinct rows only. Both shuffles go
    over as many tasks as the rows ask for; aggregations by report need no other."""
    parts = parts or parts_for(rep)
    return (rows.repartition(parts, *REPORT, *by).groupBy(*REPORT, *by).agg(F.count(F.lit(1)).alias("n"))
            .repartition(parts, *REPORT))


def sorted_rows(rep: Reports, rows: DataFrame, *by: str) -> DataFrame:
    """As ``merged_rows`` with one shuffle, each task's rows in the order of ``ORDER`` and ``by``.
    While ``collecting``, this aggregation and one by ``ORDER`` above it take one group after the
    other from the sorted rows: a task holds the distinct rows of one report only."""
    # By number alone: the quarter is a literal where one quarter is read. A floating-point sum
    # (exact here) depends on the order for Spark, which would drop the sort below a count.
    return (rows.repartition(parts_for(rep), "PRIMARYID").sortWithinPartitions(*ORDER, *by)
            .groupBy(*ORDER, *by).agg(F.sum(F.lit(1.0)).cast("bigint").alias("n"))
            .sortWithinPartitions(*ORDER))      # they are; no second sort is run


def of_report(kind: int, value: F.Column) -> F.Column:
    return F.when(F.col("kind") == kind, value)


def pieces(array: str, size: int | F.Column) -> F.Column:
    """The array cut into pieces of ``size`` (itself, if short)."""
    whole = F.col(array)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / size).cast("int")),
                      lambda i: F.slice(whole, i * size + 1, size))
    return F.when(F.size(whole) <= size, F.array(whole)).otherwise(cut)


def named_drugs(drug: DataFrame, mode: str = "clean") -> DataFrame:
    """quarter, PRIMARYID, drug of the rows with a name that is not empty: distinct raw names are
    cleaned once each (stored, so that the planner knows their size)."""
    raw = cut_lineage(drug.select("DRUGNAME").filter("DRUGNAME IS NOT NULL").distinct(), "raw-drugs")
    names = cut_lineage(raw.select("DRUGNAME", normalise("DRUGNAME", mode).alias("drug")).filter("drug != ''"), "drug-names")
    return drug.filter(F.col("PRIMARYID").isNotNull()).join(names, "DRUGNAME").select(*REPORT, "drug")


def clean_drugs(drug: DataFrame, mode: str = "clean") -> DataFrame:
    """Normalise names, drop empty ones, keep one row per (report, drug)."""
    return (drug.select(*REPORT, normalise("DRUGNAME", mode).alias("drug"))
            .filter(F.col("PRIMARYID").isNotNull() & (F.col("drug") != ""))
            .dropDuplicates(REPORT + ["drug"]))


def multi_drug_reports(drugs: DataFrame) -> DataFrame:
    """Reports with at least two distinct drugs, and their number ``k``."""
    return drugs.groupBy(*REPORT).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= 2)


def event_counts_of_reports(rep: Reports) -> DataFrame:
    """quarter, PRIMARYID, event, r: reaction rows per report and event."""
    return (rep.reac.filter(F.col("PRIMARYID").isNotNull())
            .groupBy(*REPORT, F.col("PT").alias("event")).agg(F.count(F.lit(1)).alias("r")))


def demographic_counts(rep: Reports) -> DataFrame:
    """quarter, PRIMARYID, m: demographic rows per report."""
    return (rep.demo.filter(F.col("PRIMARYID").isNotNull())
            .groupBy(*REPORT).agg(F.count(F.lit(1)).alias("m")))


def report_event_weights(rep: Reports, reports: DataFrame) -> DataFrame:
    """Per report of ``reports`` and event: w = (reaction rows with that event) x
    (demographic rows), and the columns of ``reports``. Reports without a reaction or
    demographic row drop out."""
    per_report = reports.join(demographic_counts(rep), REPORT)
    return (event_counts_of_reports(rep).join(per_report, REPORT)
            .withColumn("w", F.col("r") * F.col("m")).drop("r", "m"))


def cell_plan(drugs: DataFrame, facts: DataFrame, cell_drugs: int = DEFAULT_CELL_DRUGS,
              cell_rows: int = DEFAULT_CELL_ROWS) -> DataFrame:
    """quarter, PRIMARYID, g, s for reports with two drugs and a fact at least."""
    sizes = multi_drug_reports(drugs).join(
        facts.groupBy(*REPORT).agg(F.count(F.lit(1)).alias("e")), REPORT)
    side = F.least(F.col("k"), F.lit(cell_drugs)).cast("double")
    return sizes.select(
        *REPORT, F.ceil(F.col("k") / cell_drugs).cast("int").alias("g"),
        F.least(F.col("e"), F.ceil(side * side / 2 * F.col("e") / cell_rows)).cast("int").alias("s"))


def _deal(n: str, *cols: str) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.col(n).cast("long")).cast("int")


def explode_pairs(drugs: DataFrame, facts: DataFrame, deal_by: list[str],
                  cell_drugs: int = DEFAULT_CELL_DRUGS, cell_rows: int = DEFAULT_CELL_ROWS) -> DataFrame:
    """quarter, PRIMARYID, drug_a, drug_b (drug_a < drug_b) and the columns of ``facts``:
    every pair of a report with every fact of it. ``deal_by`` are the fact columns whose
    hash picks the slice."""
    plan = cell_plan(drugs, facts, cell_drugs, cell_rows)
    payload = [c for c in facts.columns if c not in REPORT]

    def copies(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    sided = drugs.join(plan, REPORT).withColumn("cell_s", copies("s"))
    left = sided.select(*REPORT, F.col("drug").alias("drug_a"), _deal("g", "drug").alias("cell_a"),
                        copies("g").alias("cell_b"), "cell_s")
    # The right side and the facts get key names of their own, so no join compares a
    # column with itself.
    right = sided.select(F.col("quarter").alias("_q"), F.col("PRIMARYID").alias("_p"),
                         F.col("drug").alias("drug_b"), copies("g").alias("_a"),
                         _deal("g", "drug").alias("_b"), F.col("cell_s").alias("_s"))
    dealt = (facts.join(plan, REPORT).withColumn("cell_s", _deal("s", *deal_by))
             .withColumn("cell_a", copies("g")).withColumn("cell_b", copies("g"))
             .select(*CELL, *payload))
    # A cell's work is its output, not its input: adaptive execution would merge many small
    # inputs into one task, so the number of partitions is stated.
    n = int(drugs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = ("_q", "_p", "_a", "_b", "_s")
    left, right, dealt = left.repartition(n, *CELL), right.repartition(n, *own), dealt.repartition(n, *CELL)
    on = [F.col(x) == F.col(y) for x, y in zip(CELL, own)]
    pairs = left.join(right, [*on, F.col("drug_a") < F.col("drug_b")]).select(*CELL, "drug_a", "drug_b")
    return pairs.join(dealt, CELL).select(*REPORT, "drug_a", "drug_b", *payload)


def report_facts(rep: Reports, mode: str = "clean") -> DataFrame:
    """quarter, PRIMARYID, ds, es, gs: the distinct drugs in order, (event, reaction rows) and
    (age, gender, demographic rows) of each report with two drugs, a reaction and a
    demographic row at least."""
    key = [F.col(c) for c in REPORT]
    none = F.lit(None).cast("string")
    rows = (named_drugs(rep.drug, mode).select(*key, F.lit(DRUG).alias("kind"), F.col("drug").alias("name"), none.alias("gender"))
            .unionByName(rep.reac.select(*key, F.lit(EVENT).alias("kind"), F.col("PT").alias("name"), none.alias("gender")))
            # The age travels as text, exactly: a floating-point key would be shuffled once more.
            .unionByName(rep.demo.select(*key, F.lit(DEMO).alias("kind"), (F.col("AGE") + 0.0).cast("string").alias("name"),
                                         F.col("SEX").alias("gender")))
            .filter(F.col("quarter").isNotNull() & F.col("PRIMARYID").isNotNull()))
    n = F.col("n")
    return (sorted_rows(rep, rows, "kind", "name", "gender").groupBy(*ORDER)
            .agg(F.sort_array(F.collect_list(of_report(DRUG, F.col("name")))).alias("ds"),
                 F.collect_list(of_report(EVENT, F.struct(F.col("name").alias("event"), n.alias("r")))).alias("es"),
                 F.collect_list(of_report(DEMO, F.struct(F.col("name").cast("double").alias("age"), "gender", n.alias("m")))).alias("gs"))
            .filter((F.size("ds") >= 2) & (F.size("es") > 0) & (F.size("gs") > 0)))


def counted_sides(sides: DataFrame, same: F.Column, cell_rows: int) -> DataFrame:
    """Sides (two chunks of drugs, ``da`` and ``db``; ``same``: one chunk twice) that yield a pair, with
    the number of their ``pairs`` and ``most``: facts that the pairs may meet in one cell."""
    n, k = F.size("da").cast("long"), F.size("db").cast("long")
    return (sides.withColumn("pairs", F.when(same, (n * (n - 1) / 2).cast("long")).otherwise(n * k)).filter("pairs > 0")
            .withColumn("most", F.greatest(F.lit(1), F.floor(F.lit(cell_rows) / F.col("pairs"))).cast("long")))


def yields_many(ds: str, es: str, gs: str) -> F.Column:
    """Whether a report yields more rows for each of its own than tasks that merge ``ROWS_PER_PART``
    and see ``ROWS_PER_TASK`` rows are meant to."""
    reactions = F.aggregate(es, F.lit(0.0), lambda s, e: s + e["r"])
    people = F.aggregate(gs, F.lit(0.0), lambda s, g: s + g["m"])
    k = F.size(ds).cast("double")
    return k * (k - 1) / 2 * reactions * people > (k + F.size(es) + F.size(gs)) * (ROWS_PER_TASK / ROWS_PER_PART)


def pair_event_cells(rep: Reports, mode: str = "clean", cell_drugs: int = DEFAULT_CELL_DRUGS,
                     cell_rows: int = DEFAULT_CELL_ROWS) -> DataFrame:
    """quarter, cell, many, da, db, age, gender, fs, rows: the cells of all reports that yield a row
    (two chunks of drugs, a slice of facts (event, n) and a demographic value), each of at most
    about ``cell_rows`` rows. ``cell`` is a hash to deal them by, ``many`` whether their report asks
    for that (``yields_many``)."""
    chunked = (report_facts(rep, mode).withColumn("many", yields_many("ds", "es", "gs"))
               .withColumn("chunks", pieces("ds", cell_drugs)).drop("ds"))
    sides = (chunked.select(*REPORT, "many", "es", "gs", "chunks", F.posexplode("chunks").alias("ca", "da"))
             .select(*REPORT, "many", "es", "gs", "ca", "da", F.posexplode("chunks").alias("cb", "db")).filter("ca <= cb"))
    # More facts than ``most`` are cut into slices, and one that is there more often into chunks.
    sized = (counted_sides(sides, F.col("ca") == F.col("cb"), cell_rows)
             .select(*REPORT, "many", "es", "ca", "da", "cb", "db", "pairs", "most", F.posexplode("gs").alias("g", "who")))
    m, most = F.col("who.m"), F.col("most")
    facts = F.flatten(F.transform("es", lambda e: F.transform(
        F.sequence(F.lit(0).cast("long"), F.floor((e["r"] * m - 1) / most)),
        lambda c: F.struct(e["event"].alias("event"), F.least(most, e["r"] * m - c * most).cast("int").alias("n")))))
    largest = F.array_max(F.transform("fs", lambda f: f["n"]))
    slices = pieces("fs", F.greatest(F.lit(1), F.floor(most / largest)).cast("int"))
    return (sized.withColumn("fs", facts)
            .select(*REPORT, "many", "ca", "da", "cb", "db", "pairs", "g", "who", F.posexplode(slices).alias("slice", "fs"))
            .select("quarter", F.xxhash64(*REPORT, "ca", "cb", "g", "slice").alias("cell"), "many", "da", "db",
                    F.col("who.age").alias("age"), F.col("who.gender").alias("gender"), "fs",
                    (F.col("pairs") * F.aggregate("fs", F.lit(0).cast("long"), lambda s, f: s + f["n"])).alias("rows")))


def split_cells(cells: DataFrame, cell_drugs: int, cell_rows: int) -> DataFrame:
    """Cells da, db, events (as often as they count) and any other columns, cut into cells of at most
    ``cell_drugs`` drugs a side and ``cell_rows`` rows (or one event) where they lie. Pieces are taken by
    their number, without functions of a lambda, so that Spark compiles all of it into one loop."""
    others = [c for c in cells.columns if c not in ("da", "db", "events")]

    def numbers(array: str, size: int | F.Column, first: F.Column) -> F.Column:
        return F.explode(F.sequence(first, F.floor((F.size(array) - 1) / size).cast("int")))

    def piece(array: str, size: int | F.Column, number: str) -> F.Column:
        return F.slice(array, (F.col(number) * size + 1).cast("int"), F.lit(size).cast("int")).alias(array)

    none, same = F.lit(0), F.col("da")[0] == F.col("db")[0]          # the chunks of a report share no drug
    sides = (cells.select("*", same.alias("same"), numbers("da", cell_drugs, none).alias("ca"))
             .select("*", numbers("db", cell_drugs, F.when(F.col("same"), F.col("ca")).otherwise(none)).alias("cb"))
             .select(*others, "events", "same", "ca", "cb", piece("da", cell_drugs, "ca"), piece("db", cell_drugs, "cb")))
    return (counted_sides(sides, F.col("same") & (F.col("ca") == F.col("cb")), cell_rows)
            .select("*", numbers("events", F.col("most"), none).alias("cs"))
            .select("da", "db", piece("events", F.col("most"), "cs"), *others))


def pair_events(rep: Reports, mode: str = "clean", cell_drugs: int = DEFAULT_CELL_DRUGS,
                cell_rows: int = DEFAULT_CELL_ROWS) -> DataFrame:
    """The pair-event rows: drug_a, drug_b, event, age, gender, quarter.

    One row per (pair of distinct drugs, reaction row, demographic row) of a report;
    reactions and demographics are not de-duplicated; reports without a reaction or
    demographic row drop out. Equal reaction and demographic rows of a report travel once with
    their number. Cells are stored and multiplied out inside the task. Those of reports that yield
    many rows are dealt to tasks by their hash first (as many tasks as these rows ask for); the
    others stay where they are stored, in files of a bounded number of report rows. Cells of a smaller
    budget than the default are cut from these in the task: stored or dealt one by one they
    would repeat a report's names in nearly every row.
    """
    seen = Observation()
    made = (pair_event_cells(rep, mode, max(cell_drugs, DEFAULT_CELL_DRUGS), max(cell_rows, DEFAULT_CELL_ROWS))
            .observe(seen, F.sum(F.when(F.col("many"), F.col("rows"))).alias("rows")))
    with collecting(made.sparkSession):
        cells = cut_lineage(made, "pair-event-cells")
    n = max(cells.sparkSession.sparkContext.defaultParallelism, -(-(seen.get["rows"] or 0) // ROWS_PER_TASK))
    events = F.flatten(F.transform("fs", lambda f: F.array_repeat(f["event"], f["n"])))
    who = ["age", "gender", "quarter"]
    cells = (cells.filter("not many").unionByName(cells.filter("many").repartition(n, "cell"))
             .select("da", "db", events.alias("events"), *who))
    if cell_drugs < DEFAULT_CELL_DRUGS or cell_rows < DEFAULT_CELL_ROWS:
        cells = split_cells(cells, cell_drugs, cell_rows)
    return (cells.select(F.explode("da").alias("drug_a"), "db", "events", *who)
            .select("drug_a", F.explode("db").alias("drug_b"), "events", *who).filter("drug_a < drug_b")
            .select("drug_a", "drug_b", F.explode("events").alias("event"), *who))
