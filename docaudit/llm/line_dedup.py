"""Dedup of lines over all documents: sorted hashes are streamed once, and the result is a bitmap per document."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import BLANKS, LOWER, UPPER, arrow_map, kept, small_batches

#: What the stream says of a line: it goes; that depends on the neighbouring tasks; how many documents a task's part of a run has.
GOES, OPEN, PART = 0, 1, 2
_MARKS = "id long, digest long, place int, h1 long, h2 long, kind int, task int, docs long"


def line_key(line: Column) -> Column:
    """What makes lines equal: no blanks at either end, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class _Runs:
    """Streams lines sorted by hash, document and place, and marks those that go.

    A run is all lines of one hash. A run inside the task's part is decided here; of the first and the last run, neighbouring
    tasks may hold more, so their lines stay open, and a PART row says how many documents this task has. Of an undecided run, only
    lines of fewer than ``least`` documents are held back, so memory does not grow with a run.
    """

    def __init__(self, least: int, first_stays: bool):
        self.least, self.first_stays, self.task = least, first_stays, TaskContext.get().partitionId()
        self.run, self.docs, self.last, self.held, self.first = None, 0, None, [], True
        self.out: list[dict] = []

    def mark(self, rows: dict, kind: int, docs: int = 0) -> None:
        n = len(rows["h1"])
        if n:
            self.out.append(rows | {"kind": np.full(n, kind, np.int32), "task": np.full(n, self.task, np.int32), "docs": np.full(n, docs, np.int64)})

    def end(self, last: bool) -> None:
        if self.run is None:
            return
        edge = self.first or last
        for rows in self.held:
            if edge:
                self.mark(rows, OPEN)
        if edge:
            empty = np.zeros(1, np.int64)
            self.mark({"id": empty, "no_id": np.zeros(1, bool), "digest": empty, "place": np.zeros(1, np.int32), "h1": np.array([self.run[0]]), "h2": np.array([self.run[1]])}, PART, self.docs)
        self.run, self.held, self.first = None, [], False

    def add(self, run: tuple, rows: dict) -> None:
        """rows: lines of one run, after those of the same run so far."""
        begins = self.run != run
        if begins:
            self.end(last=False)
            self.run, self.docs, self.last = run, 0, None
        docs = list(zip(rows["no_id"].tolist(), rows["id"].tolist(), rows["digest"].tolist())) if len(rows["id"]) == 1 else None
        if docs:
            new = int(docs[0] != self.last)
        else:
            change = (np.diff(rows["id"]) != 0) | (np.diff(rows["digest"]) != 0) | (np.diff(rows["no_id"].astype(np.int8)) != 0)
            first = (bool(rows["no_id"][0]), int(rows["id"][0]), int(rows["digest"][0]))
            new = int(change.sum()) + int(first != self.last)
        self.last = (bool(rows["no_id"][-1]), int(rows["id"][-1]), int(rows["digest"][-1]))
        self.docs += new
        if self.first_stays:
            head = {k: v[:1] for k, v in rows.items()} if begins else None
            if head and self.first:
                self.mark(head, OPEN)
            self.mark({k: v[1:] for k, v in rows.items()} if begins else rows, GOES)
        elif self.docs >= self.least:
            for earlier in self.held:
                self.mark(earlier, GOES)
            self.held = []
            self.mark(rows, GOES)
        elif self.first:
            self.mark(rows, OPEN)
        else:
            self.held.append(rows)

    def batch(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        c = {k: np.concatenate([x[k] for x in self.out]) for k in self.out[0]}
        self.out = []
        ids = pa.array(c["id"], pa.int64(), mask=c["no_id"])
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c[k]) for k in ("digest", "place", "h1", "h2", "kind", "task", "docs")]], ["id", "digest", "place", "h1", "h2", "kind", "task", "docs"])


def _stream(least: int, first_stays: bool):
    def run(batches):
        runs = _Runs(least, first_stays)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k) for k in ("id", "digest", "place", "h1", "h2")}
            rows = {"no_id": c["id"].is_null().to_numpy(zero_copy_only=False), "id": c["id"].fill_null(0).to_numpy()} | {k: c[k].to_numpy() for k in ("digest", "place", "h1", "h2")}
            h1, h2 = rows["h1"], rows["h2"]
            cuts = np.flatnonzero((np.diff(h1) != 0) | (np.diff(h2) != 0)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(h1)]])
            # Runs inside a batch that cannot have enough documents need no look.
            worth = np.flatnonzero(ends - starts >= (2 if first_stays else least))
            for i in sorted({0, len(starts) - 1, *worth.tolist()}):
                a, b = int(starts[i]), int(ends[i])
                runs.add((int(h1[a]), int(h2[a])), {k: v[a:b] for k, v in rows.items()})
            if (found := runs.batch()) is not None:
                yield found
        runs.end(last=True)
        if (found := runs.batch()) is not None:
            yield found

    return run


def _bitmap(places: list[int]) -> bytes:
    bits = np.ones(int(max(places)) // 8 * 8 + 8, np.uint8)  # whole bytes; lines beyond the last dropped one stay
    bits[np.asarray(places)] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def line_bitmaps(docs: DataFrame, keep: str = "none", least_docs: int = 10, least_chars: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that loses lines: key, digest (hash of its text), n_dropped, bitmap.

    bitmap: a zlib-compressed bit per line up to the last dropped one, 1 for a line that stays; later lines stay. A document
    without a row keeps all lines. Lines are equal by ``line_key``; those with a key under ``least_chars`` code points always stay.

    keep="none": lines found in ``least_docs`` documents or more go everywhere. keep="first": of every line, the first by document
    and place stays, all others go, also within a document.

    Hashes of lines are dealt to tasks by ranges of (hash, document) and sorted by hash, document and place, so that lines of a very
    common hash lie in several tasks. Each task streams its rows once. At most two runs per task reach beyond it; what is known of
    those is the only thing shared, two rows per task.

    A document is a key with a text: rows that repeat both count once, rows of one key with different texts count apart. Null
    texts are one empty line. Null keys are documents of their own by their text. An empty table gives no rows. Keys are whole
    numbers.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep must be none or first")
    t = F.col(text)
    lines = docs.select(F.col(key).cast("long").alias("id"), _digest(t).alias("digest"), F.posexplode(_lines(t)).alias("place", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= least_chars)
    lines = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "id", "digest", "place")
    order = ["h1", "h2", "id", "digest"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "place")
    marks = kept(arrow_map(dealt, _stream(least_docs, keep == "first"), _MARKS))
    # Two rows per task at most, so of a size that the number of tasks bounds.
    parts = marks.filter(F.col("kind") == PART).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.min("task").alias("first_task"))
    opened = marks.filter(F.col("kind") == OPEN).join(F.broadcast(parts), ["h1", "h2"])
    opened = opened.filter(F.col("all_docs") >= least_docs if keep == "none" else F.col("first_task") < F.col("task"))
    gone = marks.filter(F.col("kind") == GOES).select("id", "digest", "place").unionByName(opened.select("id", "digest", "place"))
    gone = gone.groupBy("id", "digest").agg(F.collect_set("place").alias("places"))
    pack = F.pandas_udf(lambda s: s.map(_bitmap), "binary")
    return gone.select(F.col("id").alias(key), "digest", F.size("places").alias("n_dropped"), pack("places").alias("bitmap"))


def _apply(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    def left(text, bitmap):
        if bitmap is None:
            return None
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
        lines = text.split("\n")
        return "\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])

    return pd.Series([left(*x) for x in zip(texts, bitmaps)], dtype=object)


def drop_lines(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text", count_as: str | None = None) -> DataFrame:
    """The documents with all their columns, their texts without the lines that the bitmaps drop; other texts unchanged, nulls too.

    ``count_as``: name of a further column with the number of lines dropped.
    """
    small_batches(docs.sparkSession)
    apply = F.pandas_udf(_apply, "string")
    marked = bitmaps.select(F.col(key).alias("_key"), F.col("digest").alias("_digest"), F.col("bitmap").alias("_bitmap"), F.col("n_dropped").alias("_n"))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"), _digest(F.col(text)).alias("digest"))
    rows = rows.join(marked.hint("shuffle_hash"), (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_key")), "left")
    less = apply(F.when(F.col("_bitmap").isNotNull(), F.coalesce("text", F.lit(""))), F.col("_bitmap"))
    changed = F.col("row").withField(text, F.coalesce(less, F.col("text")))
    count = [F.coalesce("_n", F.lit(0)).alias(count_as)] if count_as else []
    return rows.select(changed.alias("row"), *count).select("row.*", *([count_as] if count_as else []))
