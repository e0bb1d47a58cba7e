"""Text reports of small result tables, and the command line."""

from __future__ import annotations

import argparse
import json
import sys
import textwrap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegauge.operators import collapse, orderstats, pairing
from voicegauge.operators import ranktests as rt
from voicegauge.schemas import RESOURCES
from voicegauge.sources import logs


def number(v, digits: int = 1) -> str:
    return "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def p_text(p: float | None) -> str:
    return "-" if p is None else "<0.001" if p < 0.001 else f"{p:.3f}"


def interval_text(low: float | None, high: float | None) -> str:
    """An interval; an end that the data can't place is open."""
    return "-" if low is None and high is None else f"[{number(low)}, {number(high)}]"


def render(df: DataFrame) -> str:
    """A table of text of a result that is small by its meaning: a row a stage, a metric or a run."""
    rows = [[number(v) for v in r] for r in df.collect()]
    width = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, width, strict=True)).rstrip() for line in [df.columns, ["-" * w for w in width], *rows])


def summary(items: DataFrame, confidence: float = 0.95) -> DataFrame:
    s = collapse.stage_summary(items).join(orderstats.quantile_interval(items, 0.5, confidence).drop("n"), "stage")
    return collapse.in_stage_order(s)


def comparison(current: DataFrame, base: DataFrame, primary: str | None = None) -> DataFrame:
    """Paired where any item is shared, else unpaired; p values are Holm-adjusted over all stages but the primary one."""
    a, b = (collapse.item_values(x) for x in (current, base))
    if pairing.share_items(a, b):
        out = rt.compare_paired(pairing.pair_items(a, b))
    else:
        rows = current.withColumn("side", F.lit("a")).unionByName(base.withColumn("side", F.lit("b")))
        mw = rt.mann_whitney(rows)
        out = rt.two_sample_shift(rows).join(mw.select("stage", "delta", rt.normal_two_sided("z").alias("p")), "stage")
    out = out.withColumn("family_p", F.when(~F.col("stage").eqNullSafe(F.lit(primary)), F.col("p")))
    out = orderstats.holm(out, "family_p", (), ("stage",)).drop("family_p")
    return collapse.in_stage_order(out.withColumn("p_holm", F.coalesce("p_holm", F.when(F.col("stage").eqNullSafe(F.lit(primary)), F.col("p")))))


def wrapped(text: str, width: int = 88, indent: int = 13) -> str:
    """Long text as a block whose further lines are indented."""
    lines = textwrap.wrap(" ".join((text or "").split()), width, break_long_words=False, break_on_hyphens=False)
    return ("\n" + " " * indent).join(lines)


def save(text: str, path: str | None) -> bool:
    """Writes a report to a file of the driver, or prints it; a target that can't be written is named and skipped."""
    if not path:
        print(text)
        return True
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    except OSError as e:
        print(f"not written: {path}: {e.strerror}", file=sys.stderr)
        return False
    return True


def sections(log: DataFrame, items: DataFrame, confidence: float) -> list[tuple[str, DataFrame]]:
    """The parts of a report on logs, in order."""
    resources = [c for c in RESOURCES if c in log.columns]
    return [
        ("Stages", summary(items, confidence)),
        ("Runs", collapse.in_stage_order(collapse.run_rollup(items).where("run is not null"))),
        ("Resources", collapse.resource_table(log, resources).orderBy("resource", "stage")),
        ("Warnings", collapse.log_warnings(log, items)),
    ]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="voicegauge", description="Latency logs: stage summaries and comparisons")
    parser.add_argument("logs")
    parser.add_argument("--count", type=int, default=1)
    parser.add_argument("--baseline")
    parser.add_argument("--primary")
    parser.add_argument("--warmup", type=int, default=0)
    parser.add_argument("--confidence", type=float, default=0.95)
    parser.add_argument("--format", choices=("text", "tsv", "json"), default="text")
    parser.add_argument("--out", help="file to write instead of printing")
    parser.add_argument("--full", action="store_true", help="text only: runs, resources and warnings too")
    args = parser.parse_args(argv)
    logs.check_options(args.count, args.confidence, args.warmup)
    spark = SparkSession.builder.getOrCreate()
    read = lambda path: logs.typed_log(logs.read_log_text(spark, logs.resolve_logs(spark, path, args.count)), args.warmup)
    load = lambda path: collapse.collapse_items(read(path))
    current = load(args.logs)
    out = comparison(current, load(args.baseline), args.primary) if args.baseline else summary(current, args.confidence)
    if args.format == "json":
        text = json.dumps([r.asDict() for r in out.collect()])
    elif args.format == "tsv":
        text = "\n".join("\t".join(number(v, 4) for v in line) for line in [out.columns, *out.collect()])
    elif args.full and not args.baseline:
        text = "\n\n".join(f"{title}\n{render(df)}" for title, df in sections(read(args.logs), current, args.confidence))
    else:
        text = render(out)
    return 0 if save(text, args.out) else 1


if __name__ == "__main__":
    sys.exit(main())
