"""Helpers shared by the operators: shared folder, lineage cuts, Arrow maps, samples of labelled rows."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that separate words: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that Spark hands to Python at once; bounds a worker's memory when texts are long.
BATCH_ROWS = 1000
#: Bytes of the batches that kernels work on; what they make beside a batch is some times as large.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one if this is a local session without it."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="docaudit-"))
    return context.getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder. They stay there, unless the session sets
    spark.cleaner.referenceTracking.cleanCheckpoints; what is needed for a while only belongs into a ``Scratch``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class SharedTable:
    """Rows written to the shared folder as Parquet, for what is too large to keep as a checkpoint; ``drop`` removes them."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that are needed until a block ends: ``keep`` computes rows once and gives them back, the end of the block drops them all."""

    def __init__(self):
        self.tables: list[SharedTable] = []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for t in self.tables:
            t.drop()

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(SharedTable(df))
        return self.tables[-1].read()


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands BATCH_ROWS rows at most to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def small_pieces(batches):
    """The rows of the batches in pieces of at most BATCH_BYTES bytes, or of one row."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            batch = waiting.pop()
            if batch.num_rows > 1 and batch.nbytes > BATCH_BYTES:
                half = batch.num_rows // 2
                waiting += [batch.slice(half), batch.slice(0, half)]
            elif batch.num_rows:
                yield batch


def give_back() -> None:
    """Returns what this worker no longer uses to the machine: workers wait for further tasks with all that they once took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over small batches; a worker gives its memory back after each task."""
    small_batches(df.sparkSession)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def held_out(key: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves this rest; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """About ``bound`` labelled documents that are not held out: columns text, label.

    Chosen by a hash of the key, so reruns agree. Labels and keys that are null, and labels other than 0 and 1, are left out;
    of repeated keys in ``labels`` the larger label counts. The sample of labels is what is broadcast; its size is ``bound``.
    """
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").withColumn("out", held)
    rows = rows.filter(~F.col("out")).groupBy("k").agg(F.max("y").alias("y"))
    total = rows.count()
    share = min(1.0, bound / total) if total else 1.0
    rows = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "k"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(rows), "k").select("text", "y")


#: Slots of a filter of keys: 2 ** 23 bits, one MB, whatever the input's size.
FILTER_BITS = 1 << 23


def _slot(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), *keys), F.lit(FILTER_BITS))


def key_filter(rows: DataFrame, *keys: str) -> Column:
    """A filter of fixed size, as one value: for each of 256 buckets the bits of the slots of the keys that occur; null without rows. Beyond
    some ten million keys it lets nearly all rows through; results stay right, but the work it saves is lost."""
    slots = rows.select(_slot(*map(F.col, keys)).alias("slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    return bits.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits")))).scalar()


def in_filter(found: Column, *keys: Column) -> Column:
    """Whether the filter has the keys' slot: true for all keys put in, and for a few others."""
    slot = _slot(*keys)
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.element_at(found, F.bitmap_bucket_number(slot)).substr((F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("long"), (place % 8).cast("int")) == 1, F.lit(False))
