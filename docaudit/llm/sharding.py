"""Documents dealt to shards by consistent hashing: a ring of virtual nodes whose shards have bounded loads."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import SharedTable

#: Cells of the ring that small groups are gathered in, and parts that a large group can be cut into; neither depends on the input.
CELL_BITS, PARTS = 16, 256
#: A group is large from this share of a shard's bytes or rows, so there are at most twice as many large groups as shards times this.
LARGE = 64
#: Bytes counted for a row besides its text.
OVERHEAD = 8
_POSITIONS = 1 << 64


class Ring:
    """Virtual nodes of all shards; those of a shard depend on its number only, so one more shard leaves the others where they are."""

    def __init__(self, shards: int, nodes: int = 256):
        points = sorted((int.from_bytes(hashlib.sha256(f"{s}/{i}".encode()).digest()[:8], "big"), s) for s in range(shards) for i in range(nodes))
        self.shards, self.at, self.shard = shards, [p for p, _ in points], [s for _, s in points]

    def clockwise(self, position: int) -> Iterator[int]:
        """Every shard once, in the order in which their nodes come from this position on."""
        first, seen = bisect_left(self.at, position), set()
        for i in range(len(self.at)):
            s = self.shard[(first + i) % len(self.at)]
            if s not in seen:
                seen.add(s)
                yield s
                if len(seen) == self.shards:
                    return


def deal(ring: Ring, keys: list[tuple[int, list[int]]], over: float = 0.01) -> list[list[int]]:
    """The shard of every part of every key. keys: position, bytes of each part.

    A shard is full at the mean of all shards, rounded up. Keys go from large to small, by position if equal: each to the first shard clockwise from its
    position that has room for all of it; else to the one with most room, the first such clockwise, if that exceeds the mean by no more than the share ``over``.
    Else the key is cut: its parts, large ones first, continue clockwise one by one, and a part that fits nowhere goes to the shard with most room.
    """
    most = -(-sum(sum(parts) for _, parts in keys) // ring.shards)
    loads = [0] * ring.shards
    out: list[list[int]] = [[] for _ in keys]

    def put(position: int, size: int, limit: float) -> int | None:
        order = []
        for s in ring.clockwise(position):
            if loads[s] + size <= most:
                break
            order.append(s)
        else:
            s = min(order, key=lambda x: loads[x])
            if loads[s] + size > limit:
                return None
        loads[s] += size
        return s

    sums = [sum(parts) for _, parts in keys]
    for k in sorted(range(len(keys)), key=lambda k: (-sums[k], keys[k][0])):
        position, parts = keys[k]
        s = put(position, sums[k], math.inf if len(parts) == 1 else most * (1 + over))
        if s is not None:
            out[k] = [s] * len(parts)
        else:
            out[k] = [0] * len(parts)
            for i in sorted(range(len(parts)), key=lambda i: (-parts[i], i)):
                out[k][i] = put(position, parts[i], math.inf)
    return out


def _unsigned(h: int) -> int:
    return h % _POSITIONS


def _cell(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - CELL_BITS).cast("int")


def assign(docs: DataFrame, shards: int = 24, nodes: int = 256, over: float = 0.01, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot (0, 1, 2... in each shard), home (the shard that the
    ring names before loads are bounded).

    A key of the ring is a group of equal texts, at the position of the text's hash. Groups of a LARGE-th of a shard's bytes or rows or more are keys of their
    own; all smaller ones of one of 2 ** CELL_BITS equal arcs move together, as one key at the arc's beginning. ``deal`` gives every key a shard: a full shard's
    keys continue clockwise, and no shard exceeds the mean by more than the share ``over``, or one part that fits nowhere. Equal texts stay together unless no
    shard has room for the whole group, as when it exceeds the mean; then it is cut by a hash of the document's key into at most PARTS parts. One more shard takes
    its share of the keys; of the others few move.

    What the driver gets is one count per arc, large group and part of one, in number bounded by the parameters; that table is also what is broadcast. Texts are
    not shuffled; a large group is summed and numbered in parts, so no task holds it.

    Null texts have no bytes and are a group with empty ones. Null keys come first among the slots of a part; rows that repeat count one by one. Texts of equal 64-bit
    hashes are one group, which moves them together. An empty table gives no rows.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    number = F.col(key).cast("long")
    rows = docs.select(number.alias("id"), (F.octet_length(content) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("crc"), F.xxhash64(content).alias("h"), F.pmod(F.xxhash64(F.lit("part"), number), F.lit(PARTS)).cast("int").alias("salt"))
    sums = SharedTable(rows.groupBy("h", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    try:
        whole = sums.read().agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]
        least_bytes, least_rows = (max(1, x // (shards * LARGE)) for x in (whole.bytes, whole.n))
        large = sums.read().groupBy("h").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).filter((F.col("bytes") >= least_bytes) | (F.col("n") >= least_rows))
        cuts = F.least(F.lit(PARTS), F.greatest(F.ceil(F.col("bytes") / least_bytes), F.ceil(F.col("n") / least_rows))).cast("int")
        large = [(r.h, r.cuts) for r in large.select("h", cuts.alias("cuts")).collect()]
        large_rows = spark.createDataFrame(large, "h long, cuts int")
        split = sums.read().join(F.broadcast(large_rows), "h").groupBy("h", F.floor(F.col("salt") * F.col("cuts") / PARTS).cast("int").alias("part"))
        split = split.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
        cells = sums.read().join(F.broadcast(large_rows), "h", "left_anti").groupBy(_cell(F.col("h")).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    finally:
        sums.drop()
    parts: dict[int, list] = {}
    for r in sorted(split, key=lambda r: (r.h, r.part)):
        parts.setdefault(r.h, []).append(r)
    ring = Ring(shards, nodes)
    keys = [(_unsigned(h), [r.bytes for r in own]) for h, own in parts.items()] + [(r.cell << 64 - CELL_BITS, [r.bytes]) for r in cells]
    dealt = deal(ring, keys, over)
    # Bins: the parts of large groups, then cells. A shard's slots go from bin to bin.
    places: list[tuple[int | None, int, int, int, int, int]] = []
    taken = [0] * shards
    owners = [(h, r.part, r.n) for h, own in parts.items() for r in own] + [(None, r.cell, r.n) for r in cells]
    homes = [next(ring.clockwise(p)) for p, own in keys for _ in own]
    for i, ((h, part, n), shard, home) in enumerate(zip(owners, (s for own in dealt for s in own), homes)):
        places.append((h, part, i, shard, taken[shard], home))
        taken[shard] += n
    names = ("bin", "shard", "first", "home")

    def table(some: list, prefix: str) -> DataFrame:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        columns = list(zip(*some)) if some else [()] * 6
        return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["g", f"{prefix}part", *[f"{prefix}{x}" for x in names]]))

    own = table([p for p in places if p[0] is not None], "l_")
    cell = table([p for p in places if p[0] is None], "c_").drop("g")
    cut = spark.createDataFrame(large, "lh long, cuts int")
    rows = rows.join(F.broadcast(cut), F.col("h") == F.col("lh"), "left").withColumn("part", F.floor(F.col("salt") * F.col("cuts") / PARTS).cast("int"))
    rows = rows.join(F.broadcast(own), (F.col("lh") == F.col("g")) & (F.col("part") == F.col("l_part")), "left")
    rows = rows.join(F.broadcast(cell), F.when(F.col("lh").isNull(), _cell(F.col("h"))) == F.col("c_part"), "left")
    rows = rows.select("id", "h", "size", "crc", *[F.coalesce(f"l_{x}", f"c_{x}").alias(x) for x in names])
    nth = F.expr("row_number() OVER (PARTITION BY bin ORDER BY id, h)") - 1
    return rows.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + nth).alias("slot"), "home")
