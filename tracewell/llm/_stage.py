"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, set to a local one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Rows and bytes of the Arrow batches between the JVM and Python, which bound what either holds.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits for Arrow batches to those above; texts may be long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not (now.isdecimal() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


#: Removes the shuffle files of a written plan once it has ended; set for that plan only.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables in a local folder have no checksum files beside them: without Hadoop's native library the JVM starts a child
#: (chmod) for each file and folder that it makes, and a child shares the JVM's memory until its own program runs.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Stage:
    """A private folder of Parquet tables below the shared one.

    ``put`` writes a frame and reads it back, which cuts its lineage: a lost executor costs the
    reading of files, not the work before them. ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(compression="zstd", **PLAIN_FILES).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def names(self) -> list[str]:
        """The tables that are there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(conf)
        return [x.getPath().getName() for x in files.listStatus(root)] if files.exists(root) else []

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
