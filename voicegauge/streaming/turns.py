"""Turn-taking rules, each as a batch expression and as a streaming plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """(key, seq, value): a mailbox of one slot; only the newest of what nobody took is left. Works on a batch and, in update or complete mode, on a stream."""
    return df.groupBy(key).agg(F.max(seq).alias("seq"), F.max_by(value, seq).alias("value"))


def cumulative(df: DataFrame, key: str = "key", seq: str = "seq", text: str = "text") -> DataFrame:
    """df with so_far: every result repeats all of its utterance up to it."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("so_far", F.array_join(F.collect_list(F.nullif(F.trim(text), F.lit(""))).over(w), " "))


def superseded(df: DataFrame, key: str = "key", generation: str = "generation", at: str = "at") -> DataFrame:
    """df without output that came after a newer generation of its session had begun (barge-in)."""
    begun = df.groupBy(key, generation).agg(F.min(at).alias("begun"))
    newer = F.min("begun").over(Window.partitionBy(key).orderBy(generation).rowsBetween(1, Window.unboundedFollowing))
    limits = begun.withColumn("cut", newer).select(key, generation, "cut")
    return df.join(limits, [key, generation]).where((F.col("cut").isNull()) | (F.col(at) < F.col("cut"))).drop("cut")


def sessions(df: DataFrame, key: str = "user", ts: str = "ts", gap: str | Column = "5 minutes") -> DataFrame:
    """(key, start, end, n): utterances closed by a silence of `gap`, which may be an expression of the row. On a stream add a watermark to ts."""
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def gap_sessions(df: DataFrame, key: str, ts: str, gap_us: int) -> DataFrame:
    """(key, session_no, start_us, n, longest_us): the same from gaps between rows, with the longest pause inside."""
    w = Window.partitionBy(key).orderBy(ts)
    pause = F.col(ts) - F.lag(ts).over(w)
    rows = df.select(key, ts, pause.alias("pause")).withColumn("no", F.sum(F.when(F.col("pause") >= gap_us, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = F.when(F.col("pause") < gap_us, F.col("pause"))
    return rows.groupBy(key, F.col("no").alias("session_no")).agg(F.min(ts).alias("start_us"), F.count("*").alias("n"), F.coalesce(F.max(inner), F.lit(0)).alias("longest_us"))


def triggers_on_endpoint(input_mode: Column, pacing: Column, trigger: Column) -> Column:
    """Whether a turn starts at an endpoint: always at a microphone, else only in real time and if asked."""
    return (input_mode == "mic") | ((pacing == "realtime") & (trigger == "endpoint"))
