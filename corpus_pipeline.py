"""From raw documents to a training mix, in five stages over the `documents` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of `documents`.

1. quality: rows that the classifier scores under 0.3 go.
2. lines: boilerplate lines of a source are cut out; no row goes.
3. near_duplicates: of each component of the n-gram Jaccard join one row stays,
   that with the least doc_id (null last).
4. decontamination: rows that hold a benchmark item go.
5. mixing: rows that the mix takes words of, with size, source_size, target and
   taken.

Rows are judged one by one. Rows with a null doc_id go through all stages like
others, and so do rows of one doc_id with different texts. Null, blank and
wordless texts are scored by the classifier; those that pass have no shingles
and are nobody's duplicates, and the mix takes nothing of them. Rows that are
repeated whole are duplicates of each other. Texts may have any length. Empty
tables give an empty result. Columns that documents doesn't have are carried
along, whatever their names; but the four that mixing adds replace the
caller's of those names.

The classifier, the sets of shingles and the alignment have no SQL form, so
ORACLE_SQL is None; tests/llm hold run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegauge.llm._store import Store
from voicegauge.llm.decontaminate import drop_contaminated
from voicegauge.llm.lines import site_line_dedup
from voicegauge.llm.mixing import mix_sources
from voicegauge.llm.ngram_join import ngram_jaccard_join
from voicegauge.llm.quality import keep_good


def _free(docs: DataFrame, name: str) -> str:
    """name, or with marks behind it until no column of docs has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _row(docs: DataFrame) -> Column:
    """A number of each row, the same for rows that are equal in all columns."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {c: _free(docs, f"{c}_own") for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = site_line_dedup(docs.withColumnsRenamed(own))
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store = Store(spark, "near-duplicates")
    rows = docs.select(_row(docs).alias("row"), F.col("doc_id").alias("id"), "text")
    found = ngram_jaccard_join(rows, doc_id="row")
    found = found.groupBy(F.col("doc_id").alias("row"), "component_id", (F.col("n_shingles") > 0).alias("full"))
    found = store.keep(found.agg(F.count("*").alias("rows")))
    known = found.where("full").join(rows.select("row", "id").distinct(), "row")
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = known.groupBy("component_id").agg(F.min_by("row", order).alias("first"), F.count("*").alias("n"))
    gone = known.join(first.where("n > 1"), "component_id").where("row <> first")
    name = _free(docs, "row")
    gone = store.keep(gone.select(F.col("row").alias(name)))
    out = docs.withColumn(name, _row(docs)).join(gone, name, "left_anti")
    many = found.where("full and rows > 1").select(F.col("row").alias(name))
    if not many.isEmpty():  # rows repeated whole are one
        out = out.join(many, name, "left_anti").union(out.join(many, name, "left_semi").dropDuplicates([name]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store = Store(spark, "mixing")
    new = ["size", "source_size", "target", "taken"]
    row, name = _row(docs), _free(docs, "row")
    mix = mix_sources(docs.select(row.alias("row"), "source", "text"), doc_id="row")
    mix = store.keep(mix.where("taken > 0").withColumnRenamed("doc_id", name))
    own = [c for c in docs.columns if c.lower() not in new]
    named = docs.withColumn(name, row).select(name, *(F.col(f"`{c}`") for c in own))
    many = mix.groupBy(name).agg(F.count("*").alias("rows")).where("rows > 1").select(name)
    if not many.isEmpty():  # rows repeated whole: each has its own words taken
        named = named.join(many, name, "left_anti").union(named.join(many, name, "left_semi").dropDuplicates([name]))
    return named.join(mix, name).select(*(F.col(f"`{c}`") for c in own), *new)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir))
    return docs
