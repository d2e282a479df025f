"""Quality by attention over passages: a document's label is learned from a weighted mean of the codes of all its passages.

Passages are runs of words. Each is described by measures of its writing, encoded by a small layer, and weighted by gated
attention: softmax over the document of w (tanh(V h) * sigmoid(U h)). The score is a logistic function of the weighted code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.llm.bytetext import blank_table, utf8, words
from docaudit.llm.common import arrow_map, give_back, labelled_sample, small_batches, small_pieces

#: Words in a passage; a shorter rest of fewer than REST words belongs to the passage before it.
PASSAGE, REST = 64, 16
FEATURES = ("upper", "symbols", "bars", "digits", "lines", "beyond_ascii", "word_length", "stops", "repeats_1", "repeats_2", "repeats_3", "distinct", "capitals", "words")
CODE, GATE = 16, 8


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict


def _byte_kinds() -> np.ndarray:
    """For each byte: upper case, symbol, bar, digit, line end, beyond ASCII."""
    kinds = np.zeros((6, 256), np.uint8)
    kinds[0, 65:91] = 1
    for b in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{}~":
        kinds[1, b] = 1
    kinds[2, ord("|")] = 1
    kinds[3, 48:58] = 1
    kinds[4, 10] = 1
    kinds[5, 128:] = 1
    return kinds


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the document of each; a text without words is one passage of zeros."""
    data, offsets = utf8(column)
    docs = len(offsets) - 1
    starts, ends, hashes = words(data, offsets, blank_table())
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    many = np.maximum(1, counts // PASSAGE + (counts % PASSAGE >= REST))
    doc = np.repeat(np.arange(docs), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = bounds[doc] + nth * PASSAGE
    filled = counts[doc] > 0
    x = np.zeros((len(doc), len(FEATURES)))
    if not filled.any():
        return x, doc
    f = first[filled]
    n = np.diff(np.append(f, len(starts))).astype(float)
    # A passage goes from its first word to the next one's, or to the end of its text, so it does not depend on what else is in the batch.
    byte_first = starts[f]
    byte_end = np.append(byte_first[1:], len(data))
    last = np.append(doc[filled][1:] != doc[filled][:-1], True)
    byte_end[last] = offsets[doc[filled][last] + 1]
    size = (byte_end - byte_first).astype(float)
    ranges = np.stack([byte_first, byte_end], 1).ravel()
    out = [np.add.reduceat(np.append(kind[data], 0), ranges, dtype=np.int64)[::2] / size for kind in _byte_kinds()]
    length = (ends - starts).astype(float)
    out.append(np.add.reduceat(length, f) / n)
    tail = data[ends - 1]
    out.append(np.add.reduceat(((tail == 46) | (tail == 44)).astype(float), f) / n)
    doc_of_word = np.repeat(np.arange(docs), counts)
    for lag in (1, 2, 3):
        same = np.zeros(len(hashes))
        same[lag:] = (hashes[lag:] == hashes[:-lag]) & (doc_of_word[lag:] == doc_of_word[:-lag])
        out.append(np.add.reduceat(same, f) / n)
    of_word = np.repeat(np.arange(len(f)), n.astype(np.int64))
    _, seen = np.unique(hashes ^ (of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    out.append(np.bincount(of_word[seen], minlength=len(f)) / n)
    head = data[starts]
    out.append(np.add.reduceat(((head >= 65) & (head <= 90)).astype(float), f) / n)
    out.append(np.log1p(n))
    x[filled] = np.stack(out, 1)
    return x, doc


def _segments(doc: np.ndarray, docs: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(docs))


def forward(w: dict, x: np.ndarray, doc: np.ndarray, docs: int) -> dict:
    """Every document has a passage, and passages are in order of documents."""
    first = _segments(doc, docs)
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[doc])
    a = e / np.add.reduceat(e, first)[doc]
    z = np.add.reduceat(h * a[:, None], first)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ w["c"] + w["d"]}


def fit_attention(x: np.ndarray, doc: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> dict:
    """Weights by Adam on the cross entropy of the documents' labels, from a fixed start; documents of either label weigh the same in sum."""
    rng = np.random.default_rng(0)
    k = x.shape[1]
    w = {"W": rng.normal(size=(k, CODE)) / np.sqrt(k), "b": np.zeros(CODE), "V": rng.normal(size=(CODE, GATE)) / 4, "U": rng.normal(size=(CODE, GATE)) / 4, "w": rng.normal(size=GATE) / 3, "c": rng.normal(size=CODE) / 4, "d": np.zeros(())}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    first = _segments(doc, len(y))
    for step in range(1, rounds + 1):
        s = forward(w, x, doc, len(y))
        out = (1 / (1 + np.exp(-s["logit"])) - y) * weight
        dz = out[:, None] * w["c"]
        da = (dz[doc] * s["h"]).sum(1)
        de = s["a"] * (da - np.add.reduceat(s["a"] * da, first)[doc])
        dt, dg = de[:, None] * w["w"] * s["g"] * (1 - s["t"] ** 2), de[:, None] * w["w"] * s["t"] * s["g"] * (1 - s["g"])
        dh = (dz[doc] * s["a"][:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - s["h"] ** 2)
        grads = {"W": x.T @ dh, "b": dh.sum(0), "V": s["h"].T @ dt, "U": s["h"].T @ dg, "w": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ out, "d": out.sum()}
        for k, grad in grads.items():
            grad = grad + decay * w[k] / 10
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    # Labels were weighted to halves; back to their own shares.
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w["d"] = w["d"] + np.log(share / (1 - share))
    return w


def _described(batches):
    for batch in batches:
        x, doc = passages(batch.column("text"))
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32) * len(FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x.ravel().astype(np.float32)))], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, held: Column, bound: int = 6000, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Fits on about ``bound`` labelled documents that are not held out, chosen by a hash of the key; the driver receives their passages'
    features. Nothing else is bounded by it. With one label only, all scores are near it; without labels, 0.5."""
    sample = labelled_sample(docs, labels, label, bound, held, key, text)
    rows = arrow_map(sample, _described, "y double, x array<float>").toArrow()
    y = rows["y"].to_numpy()
    lists = rows["x"].combine_chunks()
    x = lists.flatten().to_numpy().astype(float).reshape(-1, len(FEATURES))
    if not len(y):
        x, doc, y = np.zeros((2, len(FEATURES))), np.arange(2), np.array([0.0, 1.0])
    else:
        doc = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()) // len(FEATURES))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    return Model(mean, scale, fit_attention((x - mean) / scale, doc, y))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of ``score`` as a column. Only the text goes to Python, and only the score comes back."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for part in texts:
            scores = []
            for piece in small_pieces([pa.record_batch([part], ["text"])]):
                x, doc = passages(piece.column("text"))
                scores.append(1 / (1 + np.exp(-forward(m.weights, np.clip((x - m.mean) / m.scale, -20, 20), doc, piece.num_rows)["logit"])))
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))
        give_back()

    small_batches(spark)
    return F.arrow_udf(run, "double")(text)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, score (probability of label 1), passages (their number), weights (the attention of each, in order).

    The whole text counts. Null and empty texts and texts without words are one passage of zeros. Rows that repeat are scored one by
    one; keys, nulls among them, are passed through. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, doc = passages(batch.column("text"))
            s = forward(m.weights, np.clip((x - m.mean) / m.scale, -20, 20), doc, batch.num_rows)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            weights = pa.ListArray.from_arrays(pa.array(cuts), pa.array(s["a"].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-s["logit"]))), pa.array(np.diff(cuts)), weights], ["id", "score", "passages", "weights"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType)])
    for name, kind in (("score", T.DoubleType()), ("passages", T.IntegerType()), ("weights", T.ArrayType(T.FloatType()))):
        schema.add(name, kind)
    return arrow_map(rows, run, schema).withColumnRenamed("id", key)
