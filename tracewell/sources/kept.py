"""Decoded texts that are kept between runs, by file and by what decides the decoding.

A run adds one Parquet folder of the texts that it had to decode; rows hold real, mtime_ns, size, text,
encoding and replaced. A file that has changed has another time or size and is decoded again. A folder
without its mark of success is one that a run was lost in, and isn't read. Language and dialect aren't
kept, since they follow from the path by which a file is met.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..options import Options

KEY = ["real", "mtime_ns", "size"]
KEPT = "real string, mtime_ns long, size long, text string, encoding string, replaced boolean"


def namespace(options: Options) -> str:
    """A name for the options that decide how bytes become text."""
    told = json.dumps({"fallback": list(options.encoding_fallback), "fast": options.fast_encoding}, sort_keys=True)
    return hashlib.sha1(told.encode()).hexdigest()[:16]


class Kept:
    """The texts kept below a folder that the driver and the executors share."""

    def __init__(self, spark: SparkSession, folder: str, options: Options):
        self.spark, self.folder, self.space = spark, str(folder).rstrip("/"), namespace(options)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _runs(self, space: str) -> list[tuple[int, str]]:
        """(time, path) of the finished runs of a namespace, oldest first; unfinished ones are left alone."""
        at = self._path(f"{self.folder}/{space}")
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        marks = [(s.getPath().toString(), self._path(s.getPath().toString() + "/_SUCCESS")) for s in found]
        return sorted((self._fs.getFileStatus(mark).getModificationTime(), name) for name, mark in marks if self._fs.exists(mark))

    def texts(self) -> DataFrame:
        """All kept rows, one for each key; two runs at once may both have written one."""
        runs = [name for _, name in self._runs(self.space)]
        if not runs:
            return self.spark.createDataFrame([], KEPT)
        return self.spark.read.schema(KEPT).parquet(*runs).dropDuplicates(KEY)

    def add(self, texts: DataFrame) -> None:
        """Keep the rows of ``texts`` that have a key, as one more run; none if there are none."""
        new = texts.where(" and ".join(f"{c} is not null" for c in KEY)).select(*[f.split()[0] for f in KEPT.split(", ")]).dropDuplicates(KEY)
        if not new.isEmpty():
            new.write.parquet(f"{self.folder}/{self.space}/{uuid.uuid4().hex}")

    def trim(self, most: int) -> None:
        """Remove the oldest runs, of whatever namespace, until ``most`` bytes are left at most."""
        top = self._path(self.folder)
        spaces = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        runs = sorted(run for space in spaces for run in self._runs(space))
        sizes = {name: self._fs.getContentSummary(self._path(name)).getLength() for _, name in runs}
        total = sum(sizes.values())
        for _, name in runs:
            if total <= most:
                return
            self._fs.delete(self._path(name), True)
            total -= sizes[name]
