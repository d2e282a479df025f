"""The contradiction report and the question snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.operators.contradictions import COUNTS, SEVERITIES


def report_lines(counts: DataFrame, claims: DataFrame, generated: str) -> DataFrame:
    """Markdown lines (block, level, key, line): what was found per severity, then every contested claim, worst first.

    ``counts`` comes from ``severity_counts``, ``claims`` from ``contested_claims``; nothing is left out.
    """
    head = counts.agg(F.sum("n").alias("n"), F.max(F.when(F.col("severity") == "HIGH", F.col("n"))).alias("high"))
    none = F.struct(*[F.lit("").alias(c) for c in ("claim_type", "entity", "source_file", "value")])
    verdict = (
        F.when(F.col("n") == 0, "Sources agree; nothing to settle.")
        .when(F.col("high") > 0, "Do not merge: findings of severity HIGH are open.")
        .otherwise("Merging is possible; no finding of severity HIGH.")
    )
    title = head.select(
        F.lit(0).alias("block"), F.lit(0).alias("level"), none.alias("key"),
        F.concat(F.lit(f"# Contradictions between sources, {generated}\n\n"), verdict, F.lit("\n")).alias("line"),
    )
    level = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int")
    sums = counts.where(F.col("n") > 0).select(
        F.lit(1).alias("block"), level.alias("level"), none.alias("key"),
        F.format_string("- %s: %s findings", "severity", F.col("n").cast("string")).alias("line"),
    )

    def place(c: str) -> Column:
        return F.format_string("%s:%d", F.col(f"{c}.source_file"), F.col(f"{c}.line_number"))

    detail = claims.select(
        F.lit(2).alias("block"), "level", F.struct("claim_type", "entity", "source_file", "value").alias("key"),
        F.concat(
            F.format_string("\n## %s %s in %s, line %d\n", "severity", "entity", "source_file", "line_number"),
            F.format_string("\nStates %s. Against it: %s HIGH, %s MEDIUM, %s LOW.\n", "value", *[F.col(c).cast("string") for c in COUNTS]),
            F.format_string("\nWidest in its group: %s (%s, %s)\n", F.col("reason"), place("a"), place("b")),
        ).alias("line"),
    )
    return title.unionByName(sums).unionByName(detail)


def write_report(lines: DataFrame, target: str) -> None:
    """The lines as text files, whose order is the order of the report."""
    lines.orderBy("block", "level", "key").select("line").write.mode("overwrite").text(target)


def write_questions(snapshot: DataFrame, target: str) -> None:
    """Replaces the snapshot; empty when nothing awaits."""
    snapshot.write.mode("overwrite").json(target)
