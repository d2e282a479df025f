"""Nearest neighbours by a forest of random-projection trees, with exact distances to the candidates of the leaves searched.

A tree splits space by the plane between two random vectors of a sample, again and again. A query walks all trees through one
priority queue, which always goes on with the part of space that is least far from the query; it stops when the
leaves reached hold enough rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import arrow_map, kept

#: Queries per pass over the index; their vectors and leaves are what a pass broadcasts.
BLOCK = 4096


@dataclass
class Forest:
    """All trees in one array of nodes. children: of a split; a leaf has its own number instead, as -1 - number, on both sides."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaves: int


def grow(sample: np.ndarray, trees: int, leaf: int, seed: int = 0) -> Forest:
    """Trees over a sample of vectors, split until ``leaf`` of them or fewer are left."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots, leaves = [], [], [], [], 0

    def number(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(5):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                normal = a - b
                length = np.linalg.norm(normal)
                if length == 0:
                    continue
                normal = normal / length
                side = sample[rows] @ normal
                offset = float(normal @ (a + b) / 2)
                if 0.05 * len(rows) > min((side < offset).sum(), (side >= offset).sum()):
                    offset = float(np.median(side))
                left = side < offset
                if left.any() and not left.all():
                    at = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append([0, 0])
                    children[at][0] = number(rows[left])
                    children[at][1] = number(rows[~left])
                    return at
        leaves += 1
        return -leaves

    for _ in range(trees):
        roots.append(number(np.arange(len(sample))))
    size = sample.shape[1]
    return Forest(np.array(normals).reshape(-1, size), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(roots, np.int64), leaves)


def leaves_of(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """For each vector the leaf in every tree."""
    out = np.empty((len(vectors), len(forest.roots)), np.int32)
    for t, root in enumerate(forest.roots):
        at = np.full(len(vectors), root)
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            node = at[open_]
            right = (vectors[open_] * forest.normals[node]).sum(1) >= forest.offsets[node]
            at[open_] = forest.children[node, right.astype(int)]
            open_ = open_[at[open_] >= 0]
        out[:, t] = -1 - at
    return out


def search(forest: Forest, sizes: np.ndarray, vector: np.ndarray, enough: int) -> list[int]:
    """The leaves to look at: nodes of all trees in one queue, by the sum of squared distances to the planes that part them from the query,
    until ``enough`` rows are reached."""
    margins = forest.normals @ vector - forest.offsets
    queue = [(0.0, int(root)) for root in forest.roots]
    heapq.heapify(queue)
    found, rows = [], 0
    while queue and rows < enough:
        priority, node = heapq.heappop(queue)
        if node < 0:
            found.append(-1 - node)
            rows += int(sizes[-1 - node])
            continue
        near = int(margins[node] >= 0)
        heapq.heappush(queue, (priority, int(forest.children[node, near])))
        heapq.heappush(queue, (priority + float(margins[node]) ** 2, int(forest.children[node, 1 - near])))
    return found


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _representatives(keep: int):
    """Of the task's rows with equal vectors, the ``keep`` smallest ids."""

    def run(batches):
        found: dict[bytes, list] = {}
        for batch in batches:
            for i, vector in zip(batch.column("id").to_pylist(), _matrix(batch.column("vector"))):
                own = found.setdefault(vector.tobytes(), [])
                if len(own) < keep:
                    heapq.heappush(own, -i)
                elif -own[0] > i:
                    heapq.heapreplace(own, -i)
        items = list(found.items())
        for at in range(0, len(items), 1000):
            part = items[at : at + 1000]
            vectors = [np.frombuffer(v, np.float64) for v, _ in part]
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.list_(pa.float64())), pa.array([sorted(-x for x in own) for _, own in part], pa.list_(pa.int64()))], ["vector", "ids"])

    return run


def _nearest(block, keep: int):
    """For the block's queries the ``keep`` nearest of the task's vectors among those in leaves that the query looks at."""

    def run(batches):
        ids, vectors, starts, looking = block.value  # queries, their vectors, and by leaf which of them look at it
        best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), []]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, leaves = _matrix(batch.column("vector")), _matrix(batch.column("leaves")).astype(np.int64)
            counts = starts[leaves + 1] - starts[leaves]
            flat = counts.ravel()
            if not flat.sum():
                continue
            row = np.repeat(np.repeat(np.arange(len(rows)), leaves.shape[1]), flat)
            first = np.repeat(starts[leaves].ravel() - (np.cumsum(flat) - flat), flat)
            pairs = np.unique(row * len(ids) + looking[first + np.arange(int(flat.sum()))])
            row, query = pairs // len(ids), pairs % len(ids)
            distance = np.concatenate([np.sqrt(((rows[row[a : a + 16384]] - vectors[query[a : a + 16384]]) ** 2).sum(1)) for a in range(0, len(row), 16384)])
            least = batch.column("least").to_numpy()[row]
            lists = batch.column("ids").take(pa.array(row))
            best = [np.concatenate([best[0], query]), np.concatenate([best[1], distance]), np.concatenate([best[2], least]), [*best[3], lists]]
            order = np.lexsort((best[2], best[1], best[0]))
            nth = np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order])
            order = order[nth < keep]
            best = [best[0][order], best[1][order], best[2][order], [pa.concat_arrays(best[3]).take(pa.array(order))]]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), best[3][0]], ["query", "score", "ids"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 10, trees: int = 16, leaf: int = 24, bound: int = 10_000, share: float = 0.8, least: int = 6000, seed: int = 0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest found of each query among all other rows, by Euclidean distance in double precision: query, rank (from 1), neighbour, score.

    ``queries``: which rows are queries. The trees are grown on about ``bound`` different vectors, chosen by hash; every row is indexed,
    and every query looks at leaves with ``share`` times as many rows as there are, and ``least`` at any rate, counted over all trees, so
    that the leaves of different trees overlap. Vectors with more structure than random ones need a far smaller share.

    Rows of equal vectors are one entry with their k + 1 smallest keys, since no query can need more; so a very common vector is
    no load. Queries come in blocks of about BLOCK; for each, a pass over the index compares candidates where they lie, and only the
    nearest of each task are shuffled.

    Rows with a null key, or whose vector is null, empty, zero or holds null or non-finite components, take no part; queries among them
    have no rows. Vectors must be of one length. Ties go to smaller keys. Rows that repeat a key and vector are one. Fewer than k other
    rows give fewer neighbours. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks")).filter(usable(F.col("vector")) & F.col("id").isNotNull())
    entries = arrow_map(rows.select("id", "vector"), _representatives(k + 1), "vector array<double>, ids array<long>")
    hashed = [F.xxhash64("vector"), F.xxhash64(F.lit("second"), "vector")]
    entries = entries.withColumns({"h1": hashed[0], "h2": hashed[1], "least": F.element_at("ids", 1)})
    # At most k + 1 ids per task meet here.
    entries = entries.groupBy("h1", "h2").agg(F.min(F.struct("least", "vector")).alias("one"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    entries = kept(entries.select("h1", F.col("one.vector").alias("vector"), F.col("one.least").alias("least"), "ids"))
    total = entries.count()
    drawn = min(1.0, bound / total) if total else 0.0
    sample = entries.filter(F.pmod(F.xxhash64(F.lit(seed), "h1"), F.lit(1 << 20)) < int(drawn * (1 << 20))).select("vector").toArrow()["vector"].combine_chunks()
    schema = "query long, rank int, neighbour long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    forest = grow(_matrix(sample), trees, leaf, seed)
    shared = spark.sparkContext.broadcast(forest)

    def place(batches):
        for batch in batches:
            found = leaves_of(shared.value, _matrix(batch.column("vector"))) if batch.num_rows else np.zeros((0, trees), np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), trees).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("least"), batch.column("ids"), lists], ["vector", "least", "ids", "leaves"])

    index = kept(arrow_map(entries.select("vector", "least", "ids"), place, "vector array<double>, least long, ids array<long>, leaves array<int>"))
    # As many numbers as the forest has leaves, which the sample bounds.
    counted = index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().toArrow()
    sizes = np.zeros(forest.leaves, np.int64)
    sizes[counted["leaf"].to_numpy()] = counted["count"].to_numpy()
    enough = max(least, int(share * total))
    shared_sizes = spark.sparkContext.broadcast(sizes)

    def walk(batches):
        for batch in batches:
            found = [search(shared.value, shared_sizes.value, v, enough) for v in _matrix(batch.column("vector"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(found, pa.list_(pa.int32()))], ["id", "vector", "leaves"])

    asked = kept(arrow_map(rows.filter("asks").select("id", "vector"), walk, "id long, vector array<double>, leaves array<int>").dropDuplicates(["id"]))
    blocks = -(-asked.count() // BLOCK)
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)) == b).toArrow()
        if not block.num_rows:
            continue
        looked = block["leaves"].combine_chunks()
        which = np.repeat(np.arange(block.num_rows), np.diff(looked.offsets.to_numpy()))
        leaf_of = looked.flatten().to_numpy()
        order = np.argsort(leaf_of, kind="stable")
        starts = np.searchsorted(leaf_of[order], np.arange(forest.leaves + 1))
        sent = spark.sparkContext.broadcast((block["id"].to_numpy(), _matrix(block["vector"].combine_chunks()), starts, which[order]))
        near = arrow_map(index, _nearest(sent, k + 1), "query long, score double, ids array<long>")
        near = near.select("query", "score", F.explode("ids").alias("neighbour")).filter("query <> neighbour")
        order = Window.partitionBy("query").orderBy("score", "neighbour")
        near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        near = near.select("query", "rank", "neighbour", "score")
        out = near if blocks == 1 else out.union(kept(near))
    return out
