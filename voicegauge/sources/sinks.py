"""Writing results: tables by run or contrast, delimited text with the union of all columns, JSON, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", "true").csv(path)


def append_transcripts(rows: DataFrame, path: str) -> None:
    """A line of JSON for each (filename, ori_text, stt_text, llm_text)."""
    rows.select("filename", "ori_text", "stt_text", "llm_text").write.mode("append").json(path)


def copy_file(spark: SparkSession, source: str, target: str) -> bool:
    """Copies a file between any stores that Spark reaches; False where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    return a.getFileSystem(conf).exists(a) and jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """All rows, with every column that any frame has."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """One file with a header, for small result tables; nested columns become JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).coalesce(1).write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_bundle(tables: dict[str, DataFrame], path: str, by: dict[str, list[str]] | None = None) -> None:
    """Each named table in a folder of its own, as delimited text; those that by names, by row large ones, as Parquet parted by its columns."""
    for name, df in tables.items():
        if by and name in by:
            write_table(df, f"{path}/{name}", by[name])
        else:
            write_delimited(df, f"{path}/{name}")
