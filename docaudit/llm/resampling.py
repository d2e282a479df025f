"""Documents drawn to resemble target texts: importance weights from hashed features, and a distributed radix sort that ranks the draws."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.bytetext import fold_table, utf8
from docaudit.llm.common import SharedTable, arrow_map, small_pieces

#: Words of more bytes are hashed one by one.
LONG_WORD = 48
#: Bits of a digit at most, and rows that share a histogram of one, at which they are dealt.
DIGIT_BITS, BLOCK_ROWS = 12, 1 << 17
_ONES = np.uint32(0xFFFFFFFF)


def _crc_steps() -> np.ndarray:
    """What a byte does to a CRC-32 state, by the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def _apart() -> np.ndarray:
    """Bytes between words, after folding: all ASCII but digits and letters."""
    apart = np.ones(256, bool)
    apart[48:58] = apart[97:123] = apart[128:] = False
    return apart


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; none reaches over the end of a text."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    own = inside[1:-1]
    return np.flatnonzero(own & (~inside[:-2] | edge[:n])), np.flatnonzero(own & (~inside[2:] | edge[1:])) + 1


def crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes of one span each, for all spans at once: byte by byte, longest first."""
    lengths = ends - starts
    out = state.copy()
    order = np.argsort(np.minimum(lengths, LONG_WORD + 1).astype(np.uint8), kind="stable")[::-1]
    long = int(np.count_nonzero(lengths > LONG_WORD))
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(out[i] ^ _ONES)) ^ 0xFFFFFFFF
    order = order[long:]
    at, left, own = starts[order], lengths[order], out[order]
    for i in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -i, "left"))  # spans longer than i
        own[:k] = steps[(own[:k] ^ data[at[:k] + i]) & 255] ^ (own[:k] >> np.uint32(8))
    out[order] = own
    return out


def features(column: pa.Array, runs: int, buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For runs of 1 to ``runs`` words: the bucket of every run and, per text, where its runs begin, with the end; then the words of each text.

    Words are what is left of a text in lower case between characters of ASCII other than digits and letters. A run is its words
    joined by one blank; its bucket is the CRC-32 of that modulo the number of buckets.
    """
    data, offsets = utf8(column)
    data, steps = fold_table()[data], _crc_steps()
    starts, ends = spans(data, offsets, _apart())
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    place = np.arange(len(starts)) - np.repeat(bounds[:-1], words)
    room = np.repeat(words, words) - place  # words from this one to the text's end
    state = crc_on(np.full(len(starts), _ONES, np.uint32), data, starts, ends, steps)
    found, begins = [], []
    first = np.arange(len(starts))
    for n in range(1, runs + 1):
        if n > 1:
            keep = room[first] >= n
            first, state = first[keep], state[keep]
            state = steps[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8))
            state = crc_on(state, data, starts[first + n - 1], ends[first + n - 1], steps)
        found.append(((state ^ _ONES) % np.uint32(buckets)).astype(np.int64))
        begins.append(np.concatenate([[0], np.cumsum(np.maximum(words - n + 1, 0))]))
    return found, begins, words


def _histogram(runs: int, buckets: int):
    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in small_pieces(batches):
            for own in features(batch.column("text"), runs, buckets)[0]:
                counts += np.bincount(own, minlength=buckets)
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, runs: int = 1, buckets: int = 10000, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts; every task sends one row per bucket at most."""
    rows = arrow_map(texts.select(F.col(text).alias("text")), _histogram(runs, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of every bucket, 1000 times the logarithm of how much likelier it is in the target than in the source, with one added to each count; rounded down."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features, weight (the sum of the gains of all features) of every document. The array of gains is what workers get; its length is the number of buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        own = shared.value
        for batch in small_pieces(batches):
            found, begins, words = features(batch.column("text"), runs, len(own))
            weight, many = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for f, b in zip(found, begins):
                sums = np.concatenate([[0], np.cumsum(own[f])])
                weight += sums[b[1:]] - sums[b[:-1]]
                many += np.diff(b)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words.astype(np.int64)), pa.array(many), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return arrow_map(rows, run, "id long, n_words long, n_features long, weight long").withColumnRenamed("id", key)


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the SHA-256 sum of seed and key: the same for a key in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _digits(low: int, high: int) -> list[tuple[int, int]]:
    """Shift and mask of the digits, lowest first, in which numbers between the two can differ."""
    bits = ((low ^ high) & (1 << 64) - 1).bit_length()
    passes = -(-bits // DIGIT_BITS)
    width = -(-bits // passes) if passes else 0
    return [(i * width, (1 << width) - 1) for i in range(passes)]


def radix_places(rows: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS) -> SharedTable:
    """The rows with a column place: 0, 1, 2... by the whole numbers in the columns ``keys``, the first of which counts most. Rows equal in all have places in any order.

    Digits are sorted from the lowest of the last key to the highest of the first, each by one stable counting sort over all rows. Rows stand
    in blocks of neighbouring places. Digits are counted per block; sums of the counts over smaller digits, and over earlier blocks of the
    same digit, tell where a block's rows of a digit go, in the order in which they stand. Places then cut the rows into the next blocks.
    A task holds rows of one block and digit at most, however often a digit occurs. Each pass shuffles the rows once and ends in the
    shared folder. Keys are not null. Columns named place, block, digit, sort_* are not kept.
    """
    rows = rows.drop("place", "block", "digit")
    bounds = rows.agg(*[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]).collect()[0].asDict()
    # A number's order is that of its bits once the sign bit is switched.
    rows = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.shiftright("place", 33))
    rows = rows.withColumns({f"sort_{i}": F.col(k).cast("long").bitwiseXOR(F.lit(-(1 << 63))) for i, k in enumerate(keys)})
    passes = [(f"sort_{i}", *d) for i, k in reversed(list(enumerate(keys))) if bounds[f"min_{k}"] is not None for d in _digits(bounds[f"min_{k}"], bounds[f"max_{k}"])]
    before = SharedTable(rows)
    for column, shift, mask in passes or [("block", 0, 0)]:
        rows = before.read().withColumn("digit", F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit(mask)).cast("int"))
        counts = rows.groupBy("digit", "block").agg(F.count("*").alias("n"))
        earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # At most 2 ** DIGIT_BITS rows.
        smaller = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", earlier(Window.orderBy("digit")).alias("smaller"))
        starts = counts.select("digit", "block", earlier(Window.partitionBy("digit").orderBy("block")).alias("start"))
        starts = starts.join(F.broadcast(smaller), "digit").select("digit", "block", (F.col("start") + F.col("smaller")).alias("start"))
        nth = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place")) - 1
        moved = rows.withColumn("nth", nth).join(starts, ["digit", "block"])
        moved = moved.withColumn("place", F.col("start") + F.col("nth")).withColumn("block", F.floor(F.col("place") / block_rows)).drop("start", "nth", "digit")
        after = SharedTable(moved)
        before.drop()
        before = after
    return before


def resample(docs: DataFrame, target: DataFrame, share: float = 0.1, runs: int = 1, buckets: int = 10000, least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_features, weight, score, rank (1, 2, 3... of those drawn, else null).

    Features are runs of words, counted by bucket over all documents and over all target texts. A document's weight is the sum of its
    features' gains; with Gumbel noise added, the highest scores are a draw without replacement in proportion to the weights. Of the N documents with
    ``least_words`` words or more, the floor(share * N) highest scores are drawn, ties by the smaller key, and ranked by ``radix_places``. Documents
    that an estimated quantile of the scores puts far below the last one drawn are not sorted; should the estimate leave too few, all are.

    Null and empty texts and texts without words have weight 0 and are not drawn. Null keys come before all others in ties. Rows that repeat are
    drawn one by one; equal ones share their score and have neighbouring ranks. Without target texts, all targets count 0. An empty table gives no rows.
    """
    gain = gains(bucket_counts(docs, runs, buckets, text), bucket_counts(target, runs, buckets, text))
    rows = weigh(docs, gain, runs, key, text).withColumnRenamed(key, "id")
    rows = SharedTable(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed))).read()
    fit = rows.filter(F.col("n_words") >= least_words)
    near = F.percentile_approx("score", float(max(0.0, 1 - share - 0.01)), F.lit(1000))
    whole = fit.agg(F.count("*").alias("n"), F.max("score").alias("top"), near.alias("near")).collect()[0]
    many = int(whole.n * round(share * 100) // 100) if abs(share * 100 - round(share * 100)) < 1e-9 else int(math.floor(whole.n * share))
    least = whole.near
    if whole.n and fit.filter(F.col("score") >= least).count() < many:
        least = None
    close = F.lit(True) if least is None else F.col("score") >= F.lit(least)
    sorted_rows = radix_places(fit.filter(close).withColumns({"below": F.lit(whole.top or 0) - F.col("score"), "order": F.coalesce("id", F.lit(-(1 << 63)))}), ["below", "order"]).read()
    rank = F.when(F.col("place") < many, F.col("place") + 1).cast("long")
    ranked = sorted_rows.select("id", "n_features", "weight", "score", rank.alias("rank"))
    others = rows.filter((F.col("n_words") < least_words) | ~close).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others).withColumnRenamed("id", key)
