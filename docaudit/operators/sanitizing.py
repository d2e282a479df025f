"""Sanitised texts and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.functions import patterns as P
from docaudit.functions import text as X


def sanitize(docs: DataFrame, text: str = "text") -> DataFrame:
    """T5: cleaned text with counts of what was removed.

    The order matters: comments first, then invisible characters, then instruction lines, so that characters
    hidden inside an instruction cannot protect it, and a comment that only shows once they are gone stays.
    Texts without a hit are passed on without being rewritten.
    """
    raw = F.col(text)
    t1 = docs.withColumn("n_comments", X.count_comments(raw)).withColumn(
        "_t", F.when(F.col("n_comments") > 0, X.strip_comments(raw)).otherwise(raw)
    )
    t2 = t1.withColumn("n_invisible", X.count_invisible(F.col("_t"))).withColumn(
        "_t", F.when(F.col("n_invisible") > 0, X.strip_invisible(F.col("_t"))).otherwise(F.col("_t"))
    )
    t3 = t2.withColumn("n_injections", X.count_injections(F.col("_t"))).withColumn(
        "clean_text", F.when(F.col("n_injections") > 0, X.drop_injections(F.col("_t"))).otherwise(F.col("_t"))
    )
    hits = F.col("n_comments") + F.col("n_invisible") + F.col("n_injections")
    return t3.drop("_t").withColumn("dirty", hits > 0)


def classify_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """S3: text files are decoded (bad bytes replaced), known binaries and undecodable others are flagged."""
    ext, bytes_ = X.suffix(F.col(path)), F.col(content)
    kind = (
        F.when(ext.isin(P.TEXT_SUFFIXES), "text")
        .when(ext.isin(P.BINARY_SUFFIXES), "binary")
        .when(F.is_valid_utf8(bytes_.cast("string")), "text")
        .otherwise("binary")
    )
    return files.withColumn("kind", kind).withColumn(
        "text", F.when(F.col("kind") == "text", F.make_valid_utf8(bytes_.cast("string")))
    )


def summarize(sanitized: DataFrame) -> DataFrame:
    """One row of totals; ``flag`` is 1 when any text had an issue."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return sanitized.agg(
        F.count(F.lit(1)).alias("n_scanned"),
        F.count_if(~F.col("dirty")).alias("n_clean"),
        total("n_comments"),
        total("n_invisible"),
        total("n_injections"),
        F.count_if("dirty").alias("n_with_issues"),
        F.coalesce(F.max(F.col("dirty").cast("int")), F.lit(0)).alias("flag"),
    )


def withhold_secrets(lines: DataFrame, line: str = "line", keys: list[str] | None = None) -> DataFrame:
    """T7 over a table of configuration lines."""
    return lines.withColumn(line, X.withhold_secret(F.col(line), keys))
