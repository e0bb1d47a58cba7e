"""One query a training-data operator: the operator over its whole table, and the columns that its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegauge.llm.chat import chat_sql, format_preferences, reply_swaps
from voicegauge.llm.decontaminate import contaminated_passages
from voicegauge.llm.lines import lines_sql, site_line_dedup
from voicegauge.llm.media import media_columns, texts_as_images
from voicegauge.llm.mixing import mix_sources, mixing_sql
from voicegauge.llm.ngram_join import ngram_jaccard_join
from voicegauge.llm.quality import quality_scores
from voicegauge.llm.secrets import secret_spans
from voicegauge.llm.substring import substring_dedup
from voicegauge.llm.toxicity import toxicity_scores

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_read(spark, sf_dir, "documents"))


@_query("op7_line_dedup", lines_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, with source as the host."""
    return site_line_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@_query("op8_mix_sources", mixing_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


@_query("op10_preference_formatting", chat_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last reply; a mask has a digit a segment."""
    out = format_preferences(reply_swaps(_read(spark, sf_dir, "conversations")))
    lengths = lambda x: F.array_join(F.transform(F.col(x), lambda s: F.length(s).cast("string")), ",")
    digits = lambda x: F.array_join(F.col(x).cast("array<string>"), "")
    return out.select(F.col("pair_id").alias("conv_id"), "common_turns", "prompt", "chosen", "rejected", digits("chosen_mask").alias("chosen_mask"), digits("rejected_mask").alias("rejected_mask"), lengths("chosen_segments").alias("chosen_lengths"), lengths("rejected_segments").alias("rejected_lengths"), "usable")


@_query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _bucket(n: int) -> str:
    return f"crc32(cast(doc_id as string)) % {n}"


@_query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), learn=f"{_bucket(5)} <> 0")
    return out.select("doc_id", F.expr(f"coalesce({_bucket(5)} = 0, true)").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), learn=f"{_bucket(3)} <> 1")
    return out.select("doc_id", F.expr(f"coalesce({_bucket(3)} = 1, true)").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds; clean documents have none."""
    return contaminated_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query("op4_media_columns")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as PPM images of 64 pixels a row; the feature is the difference hash and the start of the NPY tile's digest."""
    out = media_columns(texts_as_images(_read(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])
    return out.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat("dhash", F.lit(":"), F.substring(F.sha2("tile", 256), 1, 16)).alias("feature"),
    )


@_query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(_read(spark, sf_dir, "documents"))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", label), ",").alias("spans"), n("markov"))
