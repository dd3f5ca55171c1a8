"""Intermediate tables in the folder that all executors share.

A table written here cuts lineage: if an executor is lost later on, only the
reading tasks run again, not the stages that made the table.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bounds of one Arrow batch of whole texts; a longer text is a batch of its own.
BATCH_ROWS = 2000
BATCH_SIZE = "8m"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (tests, one machine) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lettermill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows and about ``BATCH_SIZE``: each is held by the JVM and by Python, in and out."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_SIZE)


class Scratch:
    """Tables of one operator call. ``save`` writes and rereads; ``drop`` removes early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lettermill-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table as read back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
