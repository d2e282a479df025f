"""Tables kept in the folder that all machines share, so that what is computed once outlives the executors that computed it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """The checkpoint folder of the session, or a new folder below it that is called after ``name``.

    It is what spark.checkpoint.dir names; a local session without it makes one of its own, any other must have it.
    """
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="docaudit-"))
    root = context.getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}" if name else root


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows, computed once, written to the shared folder and read from there. They stay until that folder is cleared."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


class Scratch:
    """Written tables that a block needs: inside it, call it as ``written``; its end removes them."""

    def __enter__(self):
        self.made: list[tuple[SparkSession, str]] = []
        return self

    def __call__(self, df: DataFrame, name: str = "table") -> DataFrame:
        folder = shared_folder(df.sparkSession, name)
        self.made.append((df.sparkSession, folder))
        df.write.option("compression", "zstd").parquet(folder)
        return df.sparkSession.read.parquet(folder)

    def __exit__(self, *_):
        for spark, folder in self.made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a shuffle go when the execution that made them ends, not when the driver happens to collect its garbage.

    A DataFrame must not be run twice inside; those made from it may.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
