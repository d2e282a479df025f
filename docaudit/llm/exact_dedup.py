"""Exact dedup in steps: length, then a hash of the beginning, then a hash of the whole text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import in_filter, key_filter

#: Groups of at least this share of all rows are told to all tasks.
HOT = 1000


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().filter("count > 1").select(*keys)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = 64, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per document: key, keep (key of the row of equal text that stays: the largest), group_size, kept.

    1. Rows are counted by length in bytes. 2. Rows whose length repeats are counted by length and a hash of the first ``prefix``
    characters. 3. Rows for which that repeats too get a SHA-256 sum of the whole text and are counted by it; all other rows are
    alone without their text being hashed. What repeats is passed on as a filter of one MB at any size; it may let single rows
    through to the next step, never the reverse, so the result is exact. Only hashes are shuffled, never texts.

    ``carry``: further columns computed from a document, e.g. a digest, returned under the given names.

    Null texts count as empty. Null keys are smaller than all others; in a group of null keys only, ``keep`` is null and all rows
    are kept. Rows that repeat a key and text are one group; those with its largest key are kept. An empty table gives no rows.
    """
    carry = dict(carry or {})
    names = {f"c{i}": name for i, name in enumerate(carry)}
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), content.alias("text"), F.octet_length(content).alias("bytes"), *[c.alias(n) for n, c in zip(names, carry.values())])
    lengths = key_filter(_repeated(rows, "bytes"), "bytes")
    same_length = in_filter(lengths, F.col("bytes"))
    begun = F.xxhash64(F.substring("text", 1, prefix))
    prefixes = key_filter(_repeated(rows.filter(same_length).select("bytes", begun.alias("begun")), "bytes", "begun"), "bytes", "begun")
    whole = F.when(same_length, F.when(in_filter(prefixes, F.col("bytes"), begun), F.sha2(F.col("text").cast("binary"), 256)))
    rows = rows.select("id", *names, whole.alias("whole"))
    groups = rows.filter("whole IS NOT NULL").groupBy("whole").agg(F.max("id").alias("keep"), F.count("*").alias("group_size")).filter("group_size > 1")
    # Of groups of a HOT-th of all rows or more, there are HOT at most; their rows look them up where they are.
    large = F.col("group_size") * HOT >= docs.agg(F.count("*")).scalar()
    hot = groups.filter(large).select(F.col("whole").alias("hot"), F.col("keep").alias("hot_keep"), F.col("group_size").alias("hot_size"))
    rows = rows.join(F.broadcast(hot), F.col("whole") == F.col("hot"), "left")
    # They, and rows without a hash, get a key that no group has, so that they do not meet in one task.
    alone = F.concat(F.lit("-"), F.xxhash64("id").cast("string"))
    rows = rows.withColumn("whole", F.when(F.col("hot").isNull(), F.coalesce("whole", alone)).otherwise(alone)).join(groups.filter(~large), "whole", "left")
    size = F.coalesce("hot_size", "group_size", F.lit(1)).cast("long")
    keep = F.when(size > 1, F.coalesce("hot_keep", "keep")).otherwise(F.col("id"))
    out = rows.select("id", keep.alias("keep"), size.alias("group_size"), *[F.col(n).alias(name) for n, name in names.items()])
    return out.select(F.col("id").alias(key), "keep", "group_size", F.col("id").eqNullSafe(F.col("keep")).alias("kept"), *carry)
