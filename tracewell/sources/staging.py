"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


class Tables:
    """Writes frames as Parquet below ``spark.checkpoint.dir`` and reads them back, which cuts lineage."""

    def __init__(self, spark: SparkSession, name: str):
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            at = LOCAL_CHECKPOINTS
            spark.sparkContext.setCheckpointDir(at)
        self.spark, self.root, self.count = spark, f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.count += 1
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self) -> None:
        """Remove all of them; only once nothing reads them any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(conf).delete(path, True)
