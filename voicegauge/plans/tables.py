"""The engine's relations, filled from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegauge.operators.collapse import collapse_items

HALF = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a latency log of two runs; item = user, stage = type, value = duration."""
    e = table(spark, sf_dir, "events")
    run = F.when(F.col("ts") < F.lit(HALF).cast("timestamp_ntz"), "base").otherwise("current")
    return e.select(run.alias("run"), F.col("user_id").cast("string").alias("item"), F.col("event_type").alias("stage"), "value", F.col("event_id").alias("pos"), F.col("props").alias("extra_json"), "ts")


def one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).withColumn("run", F.lit("all"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, base) items."""
    items = collapse_items(event_log(spark, sf_dir))
    return items.where("run = 'current'"), items.where("run = 'base'")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, question, text) of each user turn and the assistant turn that follows."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("text"))
    return q.join(a, ["conv_id", "turn"]).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item"), "question", "text")


def r4(c: Column | str) -> Column:
    """Four digits; NaN is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.when(~F.isnan(c), c), 4)


LOG_SQL = f"log as (select case when ts < timestamp '{HALF}' then 'base' else 'current' end as run, cast(user_id as varchar) as item, event_type as stage, value, event_id as pos, props, ts from events)"
ITEMS_SQL = f"{LOG_SQL}, items as (select run, stage, item, count(*) as n_rep, quantile_cont(value, 0.5) as value from log group by all)"
PAIRS_SQL = f"{ITEMS_SQL}, pairs as (select a.stage, a.item, a.value as a, b.value as b, a.value - b.value as d from items a join items b on a.stage = b.stage and a.item = b.item and a.run = 'current' and b.run = 'base')"
TURNS_SQL = "turns as (select cast(q.conv_id as varchar) || ':' || cast(a.turn as varchar) as item, q.text as question, a.text as text from conversations q join conversations a on q.conv_id = a.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant')"
