"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="voicegauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Store:
    """Written tables of one run of an operator. A lost executor costs only the work since the last of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        # Batches of few rows keep the Python side small when texts are long.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again: its lineage ends here."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._kept_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing reads any more, and let Spark clean up what was shuffled for earlier ones."""
        jvm = self.spark.sparkContext._jvm
        for df in kept:
            path = jvm.org.apache.hadoop.fs.Path(df._kept_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()
