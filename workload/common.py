"""Small helpers shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    """Concatenation; plain strings are literals, columns are cast to text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def longs(df: DataFrame, *names: str) -> DataFrame:
    """Counts as long values, as the SQL side returns them."""
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df
