"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import in_filter, kept, key_filter

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Number of words; null counts as no words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _digits(text: Column, n: int) -> Column:
    """The first n hexadecimal digits of the text's MD5 sum, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, share: float = 1.0) -> DataFrame:
    """One row per source: source, source_size in; adds weight, target.

    Weights repeat over the sources by code point, null last. Targets share ``share`` of all sizes by weight. A source gets at
    most ``max_repeat`` times its size; what is above goes to the others by weight until none is above: with sources ordered by
    cap over weight, the first whose share of the rest lies within its cap sets the level for all behind it. There is one row
    per source here, so the order over all of them is a small job however many documents there are.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    rows = rows.withColumn("cap", (F.col("source_size") * max_repeat).cast("double")).withColumn("level_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level_at", F.col("source").isNull(), "source")
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("level", left / weight_left)
    first = F.min(F.when(F.col("level") <= F.col("level_at"), F.struct("place", "level"))).over(everything)
    rows = rows.withColumn("first", first)
    below = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return rows.select("source", "source_size", F.col("weight").cast("int").alias("weight"), F.when(below, F.col("cap")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def _planned(rows: DataFrame, weights: Sequence[int], max_repeat: int, share: float, seed: int) -> DataFrame:
    """rows: id, source, size and anything else; adds source_size, target, copies."""
    rows = rows.withColumn("spread", _digits(F.coalesce(F.col("id").cast("string"), F.lit("")), 3))
    counts = rows.groupBy("source", "size", "spread").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, max_repeat, share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _digits(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit(""))), 8) / F.lit(float(1 << 32))
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    # Rows before each (source, size, spread): over the sizes of a source, then over the few spreads of a size.
    over_sizes = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    over_spreads = Window.partitionBy("source", "size").orderBy("spread").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "size", F.coalesce(F.sum("n").over(over_sizes), F.lit(0)).alias("before_size"))
    sizes = sizes.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sizes = sizes.withColumnsRenamed({"source": "s", "size": "z"})
    counts = counts.select("source", "size", "spread", F.coalesce(F.sum("n").over(over_spreads), F.lit(0)).alias("before_spread"))
    counts = counts.join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    counts = counts.withColumn("before", F.col("before_size") + F.col("before_spread")).drop("before_size", "before_spread")
    counts = counts.withColumnsRenamed({"source": "s", "size": "z", "spread": "p"})
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "spread").orderBy("id")))
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("spread") == F.col("p"))).drop("s", "z", "p")
    nth = F.col("before") + F.col("nth")
    copies = F.floor(F.col("rate") * nth + F.col("offset")) - F.floor(F.col("rate") * (nth - 1) + F.col("offset"))
    return rows.withColumn("copies", copies.cast("long"))


def mixing_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, share: float = 1.0, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each document: key, source, size, source_size, target, copies.

    Every document of a source is expected target / source_size times, at most ``max_repeat`` times. Within a source, documents
    stand in order of size, then of a hash of the key, then of the key; the expected copies are summed in this order from one
    random offset per source, and a document is taken once per whole number passed. Since sizes ascend, the words taken differ
    from the target by about the largest document at most. The order is cut by (source, size, hash), so no task holds a source.

    Null texts have size 0; documents of size 0 are planned like others; a source without words gets no copies. Null keys sort
    first; rows that repeat a key count one by one, and their copies may fall on either. A null source is a source of its own,
    the last one. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"))
    rows = _planned(rows, weights, max_repeat, share, seed)
    return rows.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, share: float = 1.0, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, each as often as ``mixing_plan`` takes it.

    The plan is made of keys, sources, sizes and hashes of texts; texts are shuffled once, to meet the number of their copies, and never sorted.
    Rows that agree in key, source and text share the copies planned for them: each is taken as often as they are on average, rounded down, and what
    is left over falls on one of them.
    """
    names = ["_k", "_s", "_t"]
    same = [F.col(key), F.col(source), F.xxhash64(F.coalesce(F.col(text), F.lit("")))]
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), same[2].alias("digest"))
    plan = _planned(rows, weights, max_repeat, share, seed)
    plan = kept(plan.groupBy(F.col("id").alias("_k"), F.col("source").alias("_s"), F.col("digest").alias("_t")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0"))

    def copied(df: DataFrame, plan: DataFrame, copies: Column) -> DataFrame:
        met = df.select(F.struct("*").alias("row"), *[x.alias(f"own{n}") for x, n in zip(same, names)])
        met = met.join(plan.hint("shuffle_hash"), [F.col(f"own{n}").eqNullSafe(F.col(n)) for n in names])
        return met.select("row", copies.cast("int").alias("copies")).filter("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies")))).select("col.*")

    out = copied(docs, plan, F.floor(F.col("_copies") / F.col("_rows")))
    uneven = plan.filter("_copies % _rows > 0")
    if uneven.isEmpty():
        return out
    one = Window.partitionBy(*same).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns]))
    found = docs.filter(in_filter(key_filter(uneven, "_t"), same[2])).withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").drop("_nth")
    return out.unionByName(copied(found, uneven, F.col("_copies") % F.col("_rows")))
