"""I4: near-equal passages across sources, found by MinHash bands and checked exactly.

Passages that are equal after normalising are one form. Forms link when their sets of word shingles have a Jaccard similarity of at least
``percent`` per cent; a class is what links connect. With 24 bands of 4 hashes a pair at 0.8 is missed in one of 300,000 cases, one
at 0.85 or more practically never.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.operators.assembly import passage_key
from docaudit.operators.contradictions import Keep
from docaudit.sources.shared import Scratch, written

BANDS, ROWS = 24, 4
SKETCH = 4  # words of 64 bits
CHUNK = 256  # forms at once, so that their hashes stay in the processor's cache


def word_shingles(form: Column, width: int) -> Column:
    """Distinct hashes of runs of ``width`` words; fewer words are one run. The form is split once, not once per run."""

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, width), " "))))

    return F.get(F.transform(F.array(F.split(form, " ")), runs), 0)


def _marks(batches):
    """For every set of shingles its size, its sketch, and its buckets: the hash of each band of its MinHash values.

    Bit i of the sketch is set if an odd number of shingles fall on i, so two sketches differ in no more bits than the sets in shingles.
    """
    rng = np.random.default_rng(1)
    factors = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    lists = lambda table: pa.ListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32), pa.array(table.ravel().view(np.int64)))
    for whole in batches:
        for batch in (whole.slice(at, CHUNK) for at in range(0, whole.num_rows, CHUNK)):
            sets = batch.column("shingles")
            values = sets.flatten().to_numpy().view(np.uint64)
            offsets = sets.offsets.to_numpy()
            starts = offsets[:-1] - offsets[0]
            spread = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            buckets, hashed = np.empty((batch.num_rows, BANDS), np.uint64), np.empty_like(spread)
            for band in range(BANDS):
                mixed = np.full(batch.num_rows, band, np.uint64)
                for k in range(band * ROWS, (band + 1) * ROWS):
                    np.multiply(spread, factors[k], out=hashed)
                    hashed += shifts[k]
                    hashed >>= np.uint64(8)
                    mixed = (mixed ^ np.minimum.reduceat(hashed, starts)) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(29)
                buckets[:, band] = mixed
            bits, words = np.uint64(1) << ((spread >> np.uint64(50)) & np.uint64(63)), (spread >> np.uint64(56)) % np.uint64(SKETCH)
            sketch = np.stack([np.bitwise_xor.reduceat(np.where(words == w, bits, np.uint64(0)), starts) for w in range(SKETCH)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), lists(sketch), lists(buckets)], ["id", "n", "sketch", "buckets"])


def components(links: DataFrame, keep: Keep) -> DataFrame:
    """id, root of all ends of the links (a, b): every end moves to its smallest neighbour, links move along, until none is left."""
    whole: DataFrame | None = None
    while True:
        both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a"))
        step = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")), "step")
        if step.isEmpty():
            return whole if whole is not None else step
        left, right = step.select(F.col("id").alias("a"), F.col("root").alias("c")), step.select(F.col("id").alias("b"), F.col("root").alias("d"))
        moved = links.where("a <> b").join(left, "a").join(right, "b").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
        links = keep(moved.where("a <> b").distinct(), "links")
        if whole is None:
            whole = step
        else:
            further = step.select(F.col("id").alias("root"), F.col("root").alias("further"))
            whole = keep(whole.join(further, "root", "left").select("id", F.coalesce("further", "root").alias("root")), "roots")


def _can_link(x: str, y: str, percent: int) -> Column:
    """False only for sets that sizes and sketches show to be too different: similar ones differ in (100 - p) / (100 + p) of the sum of their sizes at most."""
    bits = sum((F.bit_count(F.get(f"{x}_sketch", i).bitwiseXOR(F.get(f"{y}_sketch", i))) for i in range(SKETCH)), F.lit(0))
    apart = F.greatest(bits, F.abs(F.col(f"{x}_n") - F.col(f"{y}_n")))
    return apart * (100 + percent) <= (F.col(f"{x}_n") + F.col(f"{y}_n")) * (100 - percent)


def _sketched(df: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """With the size and the sketch of the form ``key``, called after it."""
    return df.join(marks.select(F.col("id").alias(key), F.col("n").alias(f"{key}_n"), F.col("sketch").alias(f"{key}_sketch")), key)


def _verified(pairs: DataFrame, forms: DataFrame, percent: int, width: int, keep: Keep) -> DataFrame:
    """The pairs a, b whose sets are similar enough; the forms of some pair are picked out once, and their sets looked up by id."""
    pairs = keep(pairs.select("a", "b"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    picked = forms.select("id", "form").join(wanted, "id", "left_semi")
    used = keep(picked.select("id", word_shingles(F.col("form"), width).alias("shingles")), "used")
    own = lambda x: used.select(F.col("id").alias(x), F.col("shingles").alias(f"{x}_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - shared
    return pairs.join(own("a"), "a").join(own("b"), "b").where(shared * 100 >= union * percent).select("a", "b")


def form_classes(forms: DataFrame, percent: int = 80, width: int = 3, keep: Keep = written) -> DataFrame:
    """id, root for every form (id, form) that links with another; the root is the smallest id.

    A bucket is not paired within itself. First each of its forms is compared with one of them, another one in each band; most buckets then
    lie in one class. In the others, forms outside the class that begins the bucket are compared with those of other classes. Forms are numbered,
    and only buckets of several forms are kept. Sketches rule out most pairs before their sets are made again.
    """
    forms = keep(forms.select(F.col("id").alias("key"), F.monotonically_increasing_id().alias("id"), "form"), "forms")
    sets = forms.select("id", word_shingles(F.col("form"), width).alias("shingles"))
    marks = keep(sets.mapInArrow(_marks, "id long, n int, sketch array<long>, buckets array<long>"), "marks")
    places = marks.select("id", F.explode("buckets").alias("bucket"))
    first = F.min(F.col("id").bitwiseXOR(F.col("bucket")))
    pivots = places.groupBy("bucket").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    places = keep(places.join(pivots.select("bucket", F.col("first").bitwiseXOR(F.col("bucket")).alias("pivot")), "bucket"), "places")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    near = places.where("id <> pivot").select(*pair("id", "pivot")).distinct()
    near = _sketched(_sketched(near, marks, "a"), marks, "b").where(_can_link("a", "b", percent))
    links = keep(_verified(near, forms, percent, width, keep), "links")
    roots = components(links, keep)
    at = lambda df, key, name: df.join(roots.select(F.col("id").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    placed = at(at(places, "id", "root"), "pivot", "main")
    open_buckets = placed.groupBy("bucket").agg(F.count_if(F.col("root") != F.col("main")).alias("others")).where("others > 0")
    rest = placed.where("id <> pivot").join(open_buckets.select("bucket"), "bucket", "left_semi").select("bucket", F.col("id").alias("x"), "root", "main")
    rest = keep(_sketched(rest, marks, "x"), "open")
    outside = rest.where(F.col("root") != F.col("main")).select("bucket", "x", F.col("root").alias("x_root"), "x_n", "x_sketch")
    others = rest.select("bucket", F.col("x").alias("y"), F.col("root").alias("y_root"), F.col("x_n").alias("y_n"), F.col("x_sketch").alias("y_sketch"))
    more = outside.join(others, "bucket").where("x_root <> y_root").where(_can_link("x", "y", percent)).select(*pair("x", "y")).distinct()
    more = keep(_verified(more, forms, percent, width, keep), "more")
    if not more.isEmpty():
        roots = components(keep(links.unionByName(more), "all"), keep)
    named = keep(roots.join(forms.select("id", "key"), "id"), "named")
    return named.join(named.groupBy("root").agg(F.min("key").alias("least")), "root").select(F.col("key").alias("id"), F.col("least").alias("root"))


def near_passages(passages: DataFrame, source: str, text: str, percent: int = 80, width: int = 3) -> DataFrame:
    """I4: classes of near-equal passages that several sources have, one row per class: its first form, n_forms, n_sources, n_copies, first_source.

    Copies are counted per form and source before anything else, so a passage found in a third of all texts is one form. Passages without words are left out.
    Classes are counted by id; texts are looked up for those that several sources have.
    """
    key = passages.withColumn("form", passage_key(F.col(text))).where(F.col("form") != "")
    with Scratch() as keep:
        counted = key.groupBy("form", F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
        counted = keep(counted.withColumn("id", F.unhex(F.sha2("form", 256))), "counted")
        forms = counted.select("id", "form").distinct()
        roots = keep(form_classes(forms, percent, width, keep), "classes")
        classed = counted.select("id", "source", "n").join(roots, "id", "left").withColumn("class", F.coalesce("root", "id"))
        per_source = classed.groupBy("class", "source").agg(F.sum("n").alias("n"))
        found = per_source.groupBy("class").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("n_copies"), F.min("source").alias("first_source"))
        found = keep(found.where("n_sources > 1"), "found")
        members = found.select("class").join(roots.select(F.col("root").alias("class"), "id"), "class", "left").withColumn("id", F.coalesce("id", "class"))
        texts = members.join(counted.select("id", "form"), "id").groupBy("class")
        texts = texts.agg(F.min("form").alias("passage"), F.count_distinct("id").alias("n_forms"))
        return written(found.join(texts, "class").select("passage", "n_forms", "n_sources", "n_copies", "first_source"), "classes")
