"""Tables that cut a lineage, in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tomeweave.session import checkpoint_folder


class Scratch:
    """A folder for one operator call; its tables live until ``drop`` or the end of the job."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back; a lost executor costs only unfinished tasks."""
        self._count += 1
        path = f"{self.folder}/{self._count}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, size: str = "8m") -> SparkSession:
    """Bound the bytes of an Arrow batch, of which a task and its worker hold some copies; results do not change."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark
