"""Latency logs: finding the newest, reading them with a fixed schema."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicegauge.functions.text import item_key
from voicegauge.operators.collapse import drop_warmup, numeric
from voicegauge.schemas import LOG_TEXT, RESOURCES


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, modified) of the files below a folder, in any store that Spark reads; their contents aren't loaded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"))


def newest_logs(spark: SparkSession, path: str, n: int = 1) -> list[str]:
    """The n newest latency_log_*.csv; a folder without any gives its newest other .csv that is no summary; a file is taken as it is."""
    if n <= 0:
        raise ValueError("the number of logs must be positive")
    if path.endswith(".csv"):
        return [path]
    for pattern in ("latency_log_*.csv", "*.csv"):
        found = list_files(spark, path, pattern).where(~F.col("path").endswith("_summary.csv"))
        rows = found.orderBy(F.desc("modified"), F.desc("path")).limit(n).collect()
        if rows:
            return [r.path for r in rows]
    return []


def run_log(spark: SparkSession, run_dir: str) -> str | None:
    """A run's own log: the last by name."""
    row = list_files(spark, run_dir, "latency_log_*.csv").agg(F.max("path")).first()
    return row[0]


def resolve_logs(spark: SparkSession, logs: str | list[str], n: int = 1) -> list[str]:
    return list(logs) if isinstance(logs, (list, tuple)) else newest_logs(spark, logs, n)


def read_log_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All columns as text, with run (the file) and pos (the row's place in it). Columns a file lacks are null, unknown ones are ignored.

    One read of any number of files, each parsed by the task that has it.
    """
    names = LOG_TEXT.names
    made = T.StructType([*LOG_TEXT.fields, T.StructField("run", T.StringType()), T.StructField("pos", T.LongType())])
    if not paths:
        return spark.createDataFrame([], made)

    def rows(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                lines = csv.DictReader(io.StringIO(content.decode("utf-8-sig"), newline=""))
                found = [(*(row.get(c) or None for c in names), path, i) for i, row in enumerate(lines)]
                yield pd.DataFrame(found, columns=[*names, "run", "pos"], dtype=object)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(rows, made)


def typed_log(text: DataFrame, warmup: int = 0) -> DataFrame:
    """(run, pos, item, stage, value, resources..., context..., extra_json) from text rows: tolerant numbers, items by their stem, warm-up items dropped."""
    log = text.withColumn("item", item_key(F.coalesce("item", F.lit("")))).withColumn("value", numeric(F.col("duration_ms")))
    for c in RESOURCES:
        log = log.withColumn(c, numeric(F.col(c)))
    return drop_warmup(log, warmup)


def warmup_count(spark: SparkSession, path: str) -> int:
    """The warm-up items of a run's log_averages.json; 0 without the file or the entry."""
    try:
        df = spark.read.option("multiLine", "true").json(path)
        return int(df.select("warmup_dropped_per_run").first()[0] or 0) if "warmup_dropped_per_run" in df.columns else 0
    except Exception as e:  # the reader names a missing path in its message only
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def recording_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(filename, question, speech_end_ms) of a recordings' table, one row a file name."""
    raw = spark.read.option("header", "true").csv(path)
    get = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    return raw.select(F.element_at(F.split("filename", "/"), -1).alias("filename"), get("question").alias("question"), numeric(get("speech_end_ms")).alias("speech_end_ms")).dropDuplicates(["filename"])


def with_metadata(recordings: DataFrame, metadata: DataFrame) -> DataFrame:
    """recordings (filename, ...) with the metadata of their file's name; recordings without any keep null."""
    own = metadata.select(F.col("filename").alias("__name"), *(c for c in metadata.columns if c != "filename"))
    return recordings.join(own, F.element_at(F.split("filename", "/"), -1) == F.col("__name"), "left").drop("__name")


def check_quantiles(qs: list[float]) -> list[float]:
    """Quantiles in (0, 1), percents turned to fractions, the median always among them."""
    out = set()
    for q in qs:
        q = q / 100 if q >= 1 else q
        if not 0 < q < 1:
            raise ValueError(f"a quantile must be between 0 and 1: {q}")
        out.add(q)
    return sorted(out | {0.5})


def check_options(log_count: int = 1, confidence: float = 0.95, warmup: int = 0) -> None:
    for ok, what in ((log_count > 0, "the number of logs must be positive"), (0.5 < confidence < 1, "confidence must be between 0.5 and 1"), (warmup >= 0, "warm-up can't be negative")):
        if not ok:
            raise ValueError(what)
