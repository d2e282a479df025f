"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is, and only documents have labels.

Each sentence gets a probability from the words and the beginnings of longer words in it; those of a document are joined by noisy-or. Weights are fitted to labels of
documents, so sentences get scores although none has a label, and the ones at fault can be located.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.bytetext import fold_table, letters_table, utf8, words
from docaudit.llm.common import arrow_map, labelled_sample

#: Bytes that end a sentence.
ENDS = b".!?\n"
#: Most words and beginnings of words that get a weight.
MOST_WORDS = 2048
#: Fewest documents of label 1 with a word that gets a weight, and the share of them (one in COMMON) under which its penalty grows.
LEAST_DOCS, COMMON = 4, 60
#: Penalty of the weight of a word that is not rare.
DECAY = 2e-5
#: Beginnings of so many bytes count beside whole words.
STEMS = (4, 5, 6, 7)


@dataclass
class Model:
    vocabulary: np.ndarray  # hashes of the words that have a weight, in order
    weights: np.ndarray
    bias: float


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def _sentences(column: pa.Array) -> dict:
    """The words of a batch of texts, and the sentences: runs of words with none of ENDS between them; a text without words has none."""
    data, offsets = utf8(column)
    starts, ends, *hashes = words(data, offsets, letters_table(), fold_table(), STEMS)
    stops = np.zeros(256, bool)
    stops[list(ENDS)] = True
    passed = np.concatenate([[0], np.cumsum(stops[data])])[starts]
    doc = np.searchsorted(offsets, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(passed) != 0) | (np.diff(doc) != 0)
    first = np.flatnonzero(new)
    return {"data": data, "offsets": offsets, "starts": starts, "ends": ends, "hashes": hashes, "sentence": np.cumsum(new) - 1, "first": first, "doc": doc[first]}


def _known(vocabulary: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which words have a weight, as whole or by a beginning, and the number of each weight; in order of words."""
    found = [_hits(vocabulary, own) for own in hashes]
    at, number = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    return at[order], number[order]


def _hits(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64(0xFFFF)
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary & low).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(hashes & low).astype(np.int64)])
    number = np.minimum(np.searchsorted(vocabulary, hashes[at]), len(vocabulary) - 1)
    hit = vocabulary[number] == hashes[at]
    return at[hit], number[hit]


def _document_words(batches):
    for batch in batches:
        s = _sentences(batch.column("text"))
        y = batch.column("y").to_numpy()
        doc = s["doc"][s["sentence"]]
        for d in range(batch.num_rows):
            a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
            own = np.unique(np.concatenate([x[a:b] for x in s["hashes"]]))
            own = own[own != 0]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), y[d]))], ["word", "y"])


def _bags(vocabulary: np.ndarray):
    """Per document: label, number of sentences, and the (sentence, word) pairs of words with a weight."""

    def run(batches):
        for batch in batches:
            s = _sentences(batch.column("text"))
            at, number = _known(vocabulary, s["hashes"])
            sentence = s["sentence"][at]
            doc = s["doc"][sentence] if len(at) else np.zeros(0, np.int64)
            counts = np.bincount(s["doc"], minlength=batch.num_rows)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            pairs = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (sentence, number)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(np.maximum(counts, 1), pa.int32()), *pairs], ["y", "sentences", "sentence", "word"])

    return run


def fit_noisy_or(y: np.ndarray, plain: np.ndarray, doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, size: int, rounds: int = 400, decay: float | np.ndarray = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentences' logits, by Adam on the likelihood of the documents' labels.

    plain: sentences without known words per document; doc: the document of each other sentence; sentence, word: which words
    these have; decay: pull of the weights towards 0, for all or for each. A document is clean with probability exp(-S), S the sum of softplus(logit) over its sentences.
    """
    theta = np.concatenate([np.zeros(size), [-6.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(y)
    for step in range(1, rounds + 1):
        logits = theta[-1] + np.bincount(sentence, theta[word], minlength=len(doc))
        total = plain * softplus(theta[-1]) + np.bincount(doc, softplus(logits), minlength=n)
        total = np.maximum(total, 1e-9)
        slope = (1 - y) - y / np.expm1(np.minimum(total, 50.0))
        slope = np.maximum(slope, -1e3) / n
        per = slope[doc] / (1 + np.exp(-logits))
        grad = np.concatenate([np.bincount(word, per[sentence], minlength=size), [per.sum() + (slope * plain).sum() / (1 + np.exp(-theta[-1]))]])
        grad[:-1] += decay * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, held: Column, bound: int = 8000, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Fits on about ``bound`` labelled documents that are not held out, chosen by a hash of the key; nothing else is bounded by it.

    Words and beginnings are counted by label over this sample on the executors. At most MOST_WORDS that are commoner among label 1, and
    found in LEAST_DOCS of its documents, get a weight; those in
    less than one in COMMON are pulled towards 0 in proportion to their rarity. The driver receives those and, of each sampled document, the sentences that have any. Without both labels, no word gets a weight.
    """
    sample = labelled_sample(docs, labels, label, bound, held, key, text)
    counts = arrow_map(sample, _document_words, "word long, y double").groupBy("word").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    bad, good = sizes.get(1.0, 0), sizes.get(0.0, 0)
    lift = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("n") - F.col("bad") + 0.5) / (good + 1))
    chosen = counts.filter(F.col("bad") >= LEAST_DOCS).withColumn("lift", lift).filter("lift > 2")
    chosen = chosen.orderBy((F.col("bad") * F.log("lift")).desc(), "word").limit(MOST_WORDS).select("word", "bad").collect()
    vocabulary = np.array([r.word for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, found_in = vocabulary[order], np.array([r.bad for r in chosen], float)[order]
    bags = arrow_map(sample, _bags(vocabulary), "y double, sentences int, sentence array<int>, word array<int>").toArrow()
    y, sentences = bags["y"].to_numpy(), bags["sentences"].to_numpy()
    lists = [bags[c].combine_chunks() for c in ("sentence", "word")]
    lengths = np.diff(lists[0].offsets.to_numpy()) if len(y) else np.zeros(0, np.int64)
    sentence, word = (x.flatten().to_numpy() for x in lists)
    doc_of = np.repeat(np.arange(len(y)), lengths)
    # Numbers of sentences hold within a batch only, so a sentence is a (document, number).
    pairs = doc_of.astype(np.int64) << 32 | sentence
    found, which = np.unique(pairs, return_inverse=True)
    doc = (found >> 32).astype(np.int64)
    plain = sentences - np.bincount(doc, minlength=len(y))
    if not len(y) or not bad or not good:
        return Model(vocabulary[:0], np.zeros(0), -6.0 if not bad else 6.0)
    decay = DECAY * np.maximum(1.0, bad / COMMON / found_in)
    weights, bias = fit_noisy_or(y, plain, doc, which, word, len(vocabulary), decay=decay)
    return Model(vocabulary, weights, bias)


def score(docs: DataFrame, model: Model, sure: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, score (probability that it is toxic), offending: the sentences with a probability of ``sure`` or more,
    as structs start, end (in characters, from the first to behind the last word) and score.

    The whole text counts. Null and empty texts and texts without letters count as one sentence without words. Rows that repeat
    are scored one by one; keys, nulls among them, are passed through. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        base = softplus(np.array([m.bias]))[0]
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            s = _sentences(batch.column("text"))
            at, number = _known(m.vocabulary, s["hashes"])
            logits = m.bias + np.bincount(s["sentence"][at], m.weights[number], minlength=len(s["first"])) if len(s["first"]) else np.zeros(0)
            total = np.bincount(s["doc"], softplus(logits), minlength=batch.num_rows)
            total[np.bincount(s["doc"], minlength=batch.num_rows) == 0] = base
            chance = 1 / (1 + np.exp(-logits))
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            last = np.append(s["first"][1:], len(s["starts"])) - 1
            for i in np.flatnonzero(chance >= sure).tolist():
                d = int(s["doc"][i])
                a, b, c = int(s["offsets"][d]), int(s["starts"][s["first"][i]]), int(s["ends"][last[i]])
                before, inside = (int((s["data"][x:y] & 0xC0 != 0x80).sum()) for x, y in ((a, b), (b, c)))
                spans[d].append({"start": before, "end": before + inside, "score": float(chance[i])})
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(-np.expm1(-total)), pa.array(spans, pa.list_(kind))], ["id", "score", "offending"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, score double, offending array<struct<start int, end int, score double>>").withColumnRenamed("id", key)
