"""Assembly of outputs, profile overlays, repeated passages, completeness.

The rules named in documentation only (I1-I4) are fixed here as their docstrings state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(outputs: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Rows by a fixed list of columns; a cell holds the least value delivered for it, NULL is a gap."""
    return outputs.groupBy(row).pivot(column, columns).agg(F.min(value))


def matrix_gaps(outputs: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Cells of the matrix for which nothing was delivered."""
    wanted = outputs.select(row).distinct().withColumn(column, F.explode(F.array(*map(F.lit, columns))))
    return wanted.join(outputs.select(row, column).distinct(), [row, column], "left_anti")


def assemble(sections: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Documents put together from their sections: rows in order of document and section, dealt by ranges.

    A document stays a list of rows, whatever its length; writing the result gives its sections one after another.
    """
    by = [*keys, order]
    return sections.select(*by, text).repartitionByRange(*by).sortWithinPartitions(*by)


def overlay(layers: DataFrame, keys: list[str], rank: str = "rank", value: str = "value") -> DataFrame:
    """Settings as (key, value) rows of ranked layers: the highest layer that sets a key wins."""
    return layers.groupBy(*keys).agg(F.max_by(value, rank).alias(value), F.max(rank).alias(rank))


def add_only(settings: DataFrame, mixin: DataFrame, keys: list[str]) -> DataFrame:
    """A mixin adds the keys that are not set and changes none."""
    return settings.unionByName(mixin.join(settings.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def passage_key(text: Column) -> Column:
    """I4: what two passages must share to be near-equal: their words in order, in lower case."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def shared_passages(passages: DataFrame, source: str, text: str) -> DataFrame:
    """I4: near-equal passages across sources, one row per passage.

    Near-equal means equal but for case, punctuation and spacing. Copies are counted, never paired: each source's
    copies are reduced first, so that a passage found in a third of all texts costs one small row per source and
    map task.
    """
    key = passages.withColumn("passage", passage_key(F.col(text))).where(F.col("passage") != "")
    per_source = key.groupBy(F.sha2("passage", 256).alias("passage_id"), F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.min("passage").alias("passage")
    )
    return (
        per_source.groupBy("passage_id")
        .agg(
            F.count(F.lit(1)).alias("n_sources"),
            F.sum("n").alias("n_copies"),
            F.min("source").alias("first_source"),
            F.min("passage").alias("passage"),
        )
        .where(F.col("n_sources") > 1)
    )


def completeness(required: DataFrame, inventory: DataFrame, name: str = "name") -> DataFrame:
    """Every required name with whether it is there."""
    there = inventory.select(name).distinct().withColumn("present", F.lit(True))
    return required.join(there, name, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def profile_checks(profiles: DataFrame) -> DataFrame:
    """Each profile file with its domain and version, or that it could not be parsed."""
    bad = F.col("_bad").isNotNull()
    return profiles.select(
        "file",
        (~bad).alias("valid"),
        F.when(~bad, F.coalesce("domain", F.lit("unknown"))).alias("domain"),
        F.when(~bad, F.coalesce("version", F.lit("unknown"))).alias("version"),
    )
