"""Evaluating the runs of a folder: one run, a grid with its contrasts, or two runs against each other.

    python -m voicegauge.plans.batch evaluate RUN --out DIR
    python -m voicegauge.plans.batch batch ROOT --out DIR
    python -m voicegauge.plans.batch compare BASE CONTRAST --out DIR

A run is a folder with transcripts, its settings, its prompt and its log. All
runs of a grid go through the same joins at once, and so do all contrasts.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegauge.operators import collapse, compare, contrasts, evaluate
from voicegauge.operators.settle import settled
from voicegauge.plans.report import render, save
from voicegauge.schemas import RESOURCES
from voicegauge.sources import logs, runs, sinks, transcripts

INPUTS = ("prompt_file", "mode", "num_ctx", "max_tokens", "recognizer")
#: Checks of a run that names none: an answer, and one that is complete.
CHECKS = [{"id": "non_empty", "type": "non_empty"}, {"id": "response_complete", "type": "response_complete"}]


@dataclass
class Grid:
    """Identified runs, their items in one wide table, and what their logs say besides latencies."""

    runs: DataFrame
    items: DataFrame
    extras: DataFrame | None
    resources: DataFrame | None


def load(spark: SparkSession, root: str, checks: list[dict], scenarios: str | None = None, answers: str | None = None, warmup: int = 0) -> Grid:
    """Every run below root. A grid has tens of runs; their files are found and opened one by one, their rows evaluated together."""
    known = runs.identify_runs(spark, root)
    rows = known.collect()
    known = spark.createDataFrame(rows, known.schema)  # a row a run
    if not rows:
        raise ValueError(f"{root}: no run with transcripts")
    texts = [transcripts.normal_transcripts(transcripts.read_transcripts(spark, r.transcripts)).withColumn("run", F.lit(r.run)) for r in rows]
    spec = transcripts.read_scenarios(spark, scenarios) if scenarios else None
    key = transcripts.read_answer_key(spark, answers) if answers else None
    records = transcripts.build_records(reduce(DataFrame.unionByName, texts), spec, key)
    paths = [p for p in (logs.run_log(spark, r.run) for r in rows) if p]
    latency = extras = resources = None
    if paths:
        log = logs.typed_log(logs.read_log_text(spark, paths), warmup).withColumn("run", F.regexp_replace("run", "/[^/]+$", ""))
        log = settled(log)
        latency, extras, resources = collapse.collapse_items(log), collapse.extra_rows(log), collapse.resource_medians(log, RESOURCES)
    return Grid(known, settled(evaluate.evaluate_items(settled(records), checks, latency=latency)), extras, resources)


def values(grid: Grid) -> DataFrame:
    """(run, item, metric, value) of all items; what the logs name by the file stands under its item."""
    rows = evaluate.metric_rows(grid.items)
    return rows.unionByName(grid.extras) if grid.extras is not None else rows


def outcome(grid: Grid) -> dict[str, DataFrame]:
    """The tables of single runs."""
    tables = {
        "all_items": grid.items.drop("item"),
        "leaderboard": evaluate.leaderboard(grid.items, grid.runs, grid.extras, grid.resources),
        "summaries": evaluate.metric_summaries(values(grid)),
        "categories": evaluate.by_category(grid.items),
        "acceptance": evaluate.acceptance_summary(grid.items),
        "answers": evaluate.answer_accuracy(grid.items),
        "strata": evaluate.by_stratum(grid.items),
        "impact": evaluate.impact(grid.items),
        "input_reference": evaluate.input_reference(grid.items, grid.runs),
    }
    return tables


def contrasts_of(grid: Grid, edges: DataFrame, resamples: int = 2000) -> dict[str, DataFrame]:
    """The tables of contrasts: every metric of every edge, an index of the edges by verdict, and what should have been equal."""
    spark = edges.sparkSession
    edges = spark.createDataFrame(edges.collect(), edges.schema)  # a row a contrast of a grid
    found = compare.compare_edges(values(grid), edges, compare.catalogue(spark), resamples=resamples)
    key = ["kind", "group_id", "baseline", "contrast"]
    counted = [F.count_if(F.col("verdict") == v).alias(v.replace(" ", "_")) for v in compare.VERDICT_ORDER]
    unequal = contrasts.shared_inputs(edges, grid.runs, INPUTS).where("n_distinct > 1")
    unequal = unequal.where("kind <> 'recognizer' or property <> 'recognizer'")
    return {
        "comparisons": found,
        "comparison_index": found.groupBy(*key).agg(F.count("*").alias("metrics"), *counted),
        "unequal_inputs": unequal,
        "item_differences": contrasts.item_set_differences(edges, grid.items).where("missing + extra + differing > 0"),
    }


def run_evaluate(spark: SparkSession, run: str, checks: list[dict] | None = None, **files) -> dict[str, DataFrame]:
    return outcome(load(spark, run, checks or CHECKS, **files))


def run_batch(spark: SparkSession, root: str, checks: list[dict] | None = None, resamples: int = 2000, **files) -> dict[str, DataFrame]:
    """The tables of every run and of every contrast of a grid."""
    grid = load(spark, root, checks or CHECKS, **files)
    return outcome(grid) | contrasts_of(grid, contrasts.contrast_edges(grid.runs), resamples)


def run_compare(spark: SparkSession, base: str, contrast: str, checks: list[dict] | None = None, resamples: int = 2000, **files) -> dict[str, DataFrame]:
    """Two runs, whatever they differ in."""
    a, b = (load(spark, path, checks or CHECKS, **files) for path in (base, contrast))
    both = Grid(a.runs.unionByName(b.runs), a.items.unionByName(b.items, allowMissingColumns=True), None, None)
    if a.extras is not None and b.extras is not None:
        both.extras = a.extras.union(b.extras)
    ends = a.runs.select(F.first("run").alias("baseline")).crossJoin(b.runs.select(F.first("run").alias("contrast")))  # one row each
    edges = ends.select(F.lit("pair").alias("kind"), F.lit("pair").alias("group_id"), "baseline", "contrast")
    return contrasts_of(both, edges, resamples)


def write(tables: dict[str, DataFrame], out: str) -> None:
    """The bundle: a folder a table, all_items and comparisons parted by run and by contrast, and a manifest of the tables."""
    parted = {"all_items": ["run"], "comparisons": ["kind", "group_id"]}
    sinks.write_bundle(tables, out, {k: v for k, v in parted.items() if k in tables})
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame([(name, json.dumps(df.columns)) for name, df in tables.items()], "name string, columns string")
    sinks.write_json(manifest, f"{out}/manifest")


def copy_artefacts(runs_of: DataFrame, out: str) -> int:
    """What documents how each run was made, beside its results; how many files."""
    found = 0
    for r in runs_of.select("run", "cell").collect():
        for name in ("config_used.yaml", "system_prompt.txt"):
            found += sinks.copy_file(runs_of.sparkSession, f"{r.run}/{name}", f"{out}/runs/{r.cell}/{name}")
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="voicegauge.batch", description="Evaluates runs and compares them")
    parser.add_argument("command", choices=("evaluate", "batch", "compare"))
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--out")
    parser.add_argument("--checks", help="constraint spec, YAML or JSON")
    parser.add_argument("--scenarios")
    parser.add_argument("--answers", help="answer key, CSV")
    parser.add_argument("--warmup", type=int, default=0)
    parser.add_argument("--resamples", type=int, default=2000)
    args = parser.parse_args(argv)
    if len(args.paths) != (2 if args.command == "compare" else 1):
        parser.error("compare takes two runs, the others one folder")
    logs.check_options(warmup=args.warmup)
    spark = SparkSession.builder.getOrCreate()
    checks = transcripts.read_checks(spark, args.checks) if args.checks else None
    files = {"scenarios": args.scenarios, "answers": args.answers, "warmup": args.warmup}
    if args.command == "evaluate":
        tables = run_evaluate(spark, *args.paths, checks, **files)
        shown = ["summaries", "categories", "answers"]
    else:
        run = run_batch if args.command == "batch" else run_compare
        tables = run(spark, *args.paths, checks=checks, resamples=args.resamples, **files)
        shown = ["comparison_index", "unequal_inputs", "item_differences"]
    if args.out:
        write(tables, args.out)
        if args.command == "batch":
            copy_artefacts(runs.discover_runs(spark, args.paths[0]), args.out)
    return 0 if save("\n\n".join(f"{name}\n{render(tables[name])}" for name in shown), None) else 1


if __name__ == "__main__":
    sys.exit(main())
