"""How quality filters act on each other in every order: removals counted over all permutations by difference arrays over Lehmer ranks."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.source_mixing import WORD

#: What is counted of the documents of a mask.
COUNTS = ("n", "good", "toxic")


def lehmer_rank(chosen: tuple[int, ...], k: int) -> int:
    """The first lexicographic rank among permutations of 0..k-1 that begin with ``chosen``."""
    return sum(sum(x < c and x not in chosen[:i] for x in range(k)) * math.factorial(k - 1 - i) for i, c in enumerate(chosen))


def removal_intervals(k: int) -> list[tuple[int, int, int, int]]:
    """mask, step, lo, hi: in the orders of the ranks lo to hi - 1, documents that fail the filters of the mask go at this step.

    A document goes at step s if the first s - 1 filters are outside its mask and the next one is inside. All orders that begin
    alike stand together in lexicographic order, so every such beginning is one interval.
    """
    out = []
    for mask in range(1, 1 << k):
        inside, outside = [f for f in range(k) if mask >> f & 1], [f for f in range(k) if not mask >> f & 1]
        for step in range(1, len(outside) + 2):
            for before in permutations(outside, step - 1):
                for f in inside:
                    lo = lehmer_rank((*before, f), k)
                    out.append((mask, step, lo, lo + math.factorial(k - step)))
    return out


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D: under 200 words; fewer than half of its words distinct; over 2 per cent of its
    code points in A-Z; one of the characters ``#$%&*|`` in it. Null counts as empty; words are case-sensitive."""
    content = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(content, F.lit(WORD), F.lit(0))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * F.regexp_count(content, F.lit("[A-Z]")) > 2 * F.length(content), content.rlike("[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column], part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: how many documents of each part fail exactly the filters of the mask, and how many of them are labelled good and toxic.

    Bit i of the mask belongs to the i-th of ``failures``; the next bit belongs to the filter of copies, which a document fails if
    a smaller key has an identical text, in any part. Texts are compared by their SHA-256 sums. Copies are found by joining rows
    with the smallest key of each text on text and key, so a group of copies is spread over all tasks.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    flags = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures.values())]
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), sum(flags, F.lit(0)).alias("mask"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("sum"))
    first = rows.filter("id IS NOT NULL").groupBy("sum").agg(F.min("id").alias("first")).withColumnRenamed("sum", "s")
    copies = F.when(F.col("first").isNull() & F.col("id").isNotNull(), 1 << len(flags)).otherwise(0)
    rows = rows.join(first, (F.col("sum") == F.col("s")) & (F.col("id") == F.col("first")), "left").select("id", "part", (F.col("mask") + copies).alias("mask"))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, F.col("id") == F.col("k"), "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit(counts: DataFrame, names: str) -> DataFrame:
    """Of ``mask_counts``, one row per part, order of the filters and step, with all counts of the contract below; ``names``: a letter per bit of the mask.

    Columns: part, filter_order, step, kept (left after the step), removed (at it), redundant (failing its filter, but removed
    earlier), unique_fails (failing no other filter), good_lost and toxic_lost (removed at it), shapley (what its filter removes, summed over all orders).

    Every mask's removal steps are intervals of lexicographic ranks. A count is added where one begins and taken off where it ends; sums
    over the ranks then give what each step removes in each order. Masks, intervals and orders depend on the filters only, and
    documents come in as counts, so the work grows with parts, not with documents.
    """
    spark, k = counts.sparkSession, len(names)
    orders = ["".join(p) for p in permutations(sorted(names))]
    intervals = spark.createDataFrame(removal_intervals(k), "mask int, step int, lo int, hi int")
    ends = F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign")))).alias("end")
    steps = counts.join(F.broadcast(intervals), "mask").select("part", "step", ends, *COUNTS)
    steps = steps.select("part", "step", "end.rank", *[(F.col(c) * F.col("end.sign")).alias(c) for c in COUNTS]).filter(F.col("rank") < len(orders))
    grid = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    grid = grid.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    steps = steps.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    # Dealt by part once: all windows below stay inside a part.
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.repartition("part").withColumns({c: F.sum(c).over(along) for c in COUNTS})
    order = F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1)
    steps = steps.withColumn("filter_order", order).withColumn("filter", order.substr(F.col("step"), F.lit(1)))
    steps = steps.withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "filter")))
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    bit = [F.shiftleft(F.lit(1), i) for i in range(k)]
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(b) > 0, F.col("n")).otherwise(0)) for b in bit]
    alone = [F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0)) for b in bit]
    totals = counts.groupBy(F.col("part").alias("p")).agg(F.sum("n").alias("all"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    steps = steps.withColumn("gone", gone).join(totals, F.col("part") == F.col("p"))
    at = F.instr(F.lit(names), F.col("filter"))
    return steps.select("part", "filter_order", "step", (F.col("all") - F.col("gone")).alias("kept"), F.col("n").alias("removed"), (F.element_at("fails", at) - F.col("n")).alias("redundant"), F.element_at("alone", at).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``audit`` of the filters A to D of ``text_failures`` and of E, the filter of copies.

    Null texts are empty, null parts the part of the empty string. Rows without a key fail E never and are nobody's original; of rows that repeat
    the smallest key of a text, none fails E. Rows that repeat count one by one. Labels of repeated keys: the larger counts; documents
    without a label are neither good nor toxic. Very long texts count whole, each inside one row. An empty table gives no rows.
    """
    return audit(mask_counts(docs, labels, dict(zip("ABCD", text_failures(F.col(text)))), part, key, text), "ABCDE")
