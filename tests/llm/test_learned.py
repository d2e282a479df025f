"""Toxicity and quality by held-out accuracy, and the vector forest by recall."""

import math
import random
import re
from functools import cache

import numpy as np
import pytest
from docaudit.llm import bytetext, quality, toxicity, vector_forest
from docaudit.llm.common import held_out
from pyspark.sql import functions as F

GOOD = [a + b for a in ("ba", "co", "du", "fe", "gi", "ha") for b in ("la", "mo", "nu", "pe", "ri", "so")]
BAD = ["vilex", "grokker", "snarfen"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, toxic, fine = [], [], []
    for i in range(900):
        words = [rng.choice(GOOD) for _ in range(rng.randint(5, 200))]
        toxic.append(int(rng.random() < 0.3))
        for _ in range(3 * toxic[-1]):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = "".join(w + (". " if rng.random() < 0.1 else " ") for w in words)
        fine.append(int(rng.random() < 0.7))
        if not fine[-1]:
            text = rng.choice([text.upper(), text.replace(" ", "%% "), " | ".join(words), " ".join(w for w in words for _ in range(4))])
        rows.append((i, text))
    return rows, toxic, fine


def tables(spark, docs, corpus):
    rows, toxic, fine = corpus
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(fine, toxic))] + [(None, 1, 1), (5000, None, 0), (5001, 7, 7)], "doc_id long, quality int, toxic int")
    odd = [(9000, None), (9001, ""), (9002, "?!. \n"), (None, "null key"), (3, rows[3][1])]
    return docs(rows + odd), labels


def accuracy(found, truth, held, threshold):
    rows = [r for r in found if r.held == held and r.doc_id is not None and r.doc_id < len(truth)]
    return np.mean([(r.score >= threshold) == bool(truth[r.doc_id]) for r in rows])


def test_toxicity(spark, docs, corpus):
    df, labels = tables(spark, docs, corpus)
    model = toxicity.train(df, labels, held_out(F.col("k"), 3, 1))
    found = toxicity.score(df, model).withColumn("held", held_out(F.col("doc_id"), 3, 1)).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 for r in found)
    assert accuracy(found, corpus[1], True, 0.7) > 0.97
    text = dict(corpus[0])
    located = [(r, s) for r in found for s in r.offending if r.doc_id is not None and r.doc_id < 900]
    assert located and all(any(b in text[r.doc_id][s.start : s.end].lower() for b in BAD) for r, s in located)
    assert toxicity.score(docs([]), model).collect() == []


def test_toxicity_of_varied_words(spark, docs):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, rare = [letters(6) for _ in range(300)], [letters(8) for _ in range(200)]
    toxic = [i % 2 for i in range(1800)]
    # Each of the rare words is in about one in 100 of the toxic documents.
    rows = [(i, " ".join(rng.choices(common, k=20) + rng.choices(rare, k=2 * t))) for i, t in enumerate(toxic)]
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    held = held_out(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs(rows), labels, held_out(F.col("k"), 3, 1))
    found = toxicity.score(docs(rows), model).filter(held).collect()
    assert sum((r.score >= 0.5) == toxic[r.doc_id] for r in found) > 0.9 * len(found)


def test_quality(spark, docs, corpus):
    df, labels = tables(spark, docs, corpus)
    model = quality.train(df, labels, held_out(F.col("k"), 5, 0))
    found = quality.score(df, model).withColumn("held", held_out(F.col("doc_id"), 5, 0)).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 for r in found)
    assert accuracy(found, corpus[2], True, 0.3) > 0.95
    assert all(len(r.weights) == r.passages and sum(r.weights) == pytest.approx(1, abs=1e-4) for r in found)
    rows = quality.score(df.select(F.struct("*").alias("row"), "text"), model, key="row").select("row.*")
    assert rows.columns == df.columns and rows.count() == df.count()


def test_gradients_of_attention():
    rng = np.random.default_rng(1)
    x, doc, y = rng.normal(size=(30, 5)), np.sort(rng.integers(0, 8, 30)), rng.integers(0, 2, 8).astype(float)
    doc[:8] = np.arange(8)
    doc.sort()
    w = quality.fit_attention(x, doc, y, rounds=300)
    s = quality.forward(w, x, doc, 8)
    assert ((s["logit"] > np.log(y.mean() / (1 - y.mean()))) == (y > 0.5)).all()


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs([(1, "a b c"), (2, None)])
    assert len(toxicity.score(df, toxicity.train(df, none, held_out(F.col("k"), 3, 1))).collect()) == 2
    assert len(quality.score(df, quality.train(df, none, held_out(F.col("k"), 5, 0))).collect()) == 2


def test_forest(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(3000 + i, vectors[7].tolist()) for i in range(1000)]  # one very common vector
    odd = [(9000, None), (9100, []), (9200, [0.0] * 16), (9300, [float("nan")] + [1.0] * 15), (9400, [None] + [1.0] * 15), (9500, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (100, vectors[100].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("leaves", F.lit("x")).repartition(6)
    found = vector_forest.nearest(df, F.col("vec_id") % 100 == 0, share=0.5, least=1).collect()
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows])
    hits = total = 0
    for q in range(0, 4000, 100):
        distance = np.sqrt(((points - points[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, distance)) if ids[j] != q][:10]
        got = sorted((r.rank, r.neighbour, r.score) for r in found if r.query == q)
        assert [r for r, _, _ in got] == list(range(1, len(got) + 1)) and len(got) == 10
        assert all(s == pytest.approx(np.sqrt(((points[n] - points[q]) ** 2).sum()), abs=1e-12) for _, n, s in got)
        hits += len({n for _, n, _ in got} & {int(ids[j]) for j in order})
        total += 10
    assert hits / total >= 0.9
    assert {r.query for r in found} == set(range(0, 4000, 100))
    small = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query, r.neighbour) for r in vector_forest.nearest(small, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert vector_forest.nearest(small.filter("vec_id > 5"), F.lit(True)).collect() == []


# Scores by plain loops over one text


def plain_passages(text):
    """The measures of every passage of a text, one by one."""
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    if not words:
        return [[0.0] * len(quality.FEATURES)]
    many = max(1, len(words) // 64 + (len(words) % 64 >= 16))
    cuts = [64 * i for i in range(many)] + [len(words)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        part = text[words[a][0] : words[b][0] if b < len(words) else len(text)]
        own = [text[x:y] for x, y in words[a:b]]
        share = lambda chars: sum(c in chars for c in part) / len(part)  # noqa: E731,B023
        same = lambda lag: sum(i >= lag and text[slice(*words[i])] == text[slice(*words[i - lag])] for i in range(a, b)) / len(own)  # noqa: E731,B023
        out.append([
            share(range(65, 91)), share(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{}~"), share(b"|"), share(b"0123456789"), share(b"\n"), share(range(128, 256)),
            sum(map(len, own)) / len(own), sum(w[-1:] in (b".", b",") for w in own) / len(own), same(1), same(2), same(3),
            len(set(own)) / len(own), sum(65 <= w[0] <= 90 for w in own) / len(own), math.log1p(len(own)),
        ])
    return out


def plain_quality(model, text):
    w = model.weights
    codes, pulls = [], []
    for x in plain_passages((text or "").encode()):
        x = [min(max((v - m) / s, -20), 20) for v, m, s in zip(x, model.mean, model.scale)]
        h = [math.tanh(sum(v * w["W"][i][j] for i, v in enumerate(x)) + w["b"][j]) for j in range(quality.CODE)]
        t = [math.tanh(sum(h[i] * w["V"][i][j] for i in range(quality.CODE))) for j in range(quality.GATE)]
        g = [1 / (1 + math.exp(-sum(h[i] * w["U"][i][j] for i in range(quality.CODE)))) for j in range(quality.GATE)]
        codes.append(h)
        pulls.append(math.exp(sum(a * b * c for a, b, c in zip(t, g, w["w"]))))
    z = [sum(p * h[j] for p, h in zip(pulls, codes)) / sum(pulls) for j in range(quality.CODE)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["c"])) + float(w["d"]))))


def test_quality_against_plain_loops(spark, docs, corpus):
    df, labels = tables(spark, docs, corpus)
    model = quality.train(df, labels, held_out(F.col("k"), 5, 0))
    rng = random.Random(8)
    texts = [corpus[0][i][1] for i in range(0, 900, 30)] + [None, "", " \n ", "  outer blanks \n\n", "\n\nbefore", "é | É 12", " ".join(rng.choice(GOOD) for _ in range(5000)) + "\n"]
    rows = docs(list(enumerate(texts))).repartition(2)
    got = {r.doc_id: r.score for r in quality.score(rows, model).collect()}
    column = {r.doc_id: r.s for r in rows.select("doc_id", quality.score_column(spark, model, F.col("text")).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_quality(model, text), abs=1e-9) and column[i] == pytest.approx(got[i], abs=1e-12)


def test_toxicity_against_plain_loops(spark, docs, corpus):
    """Noisy-or over sentences, from the hashes of single words that the model knows."""
    df, labels = tables(spark, docs, corpus)
    model = toxicity.train(df, labels, held_out(F.col("k"), 3, 1))
    weights = dict(zip(model.vocabulary.tolist(), model.weights.tolist()))
    texts = [corpus[0][i][1] for i in range(0, 900, 15)] + [None, "", "!!", "vilex", "VILEX. grokker? fine"]
    got = {r.doc_id: r.score for r in toxicity.score(docs(list(enumerate(texts))), model).collect()}
    @cache
    def pull(word):
        """The weights of a word and of its beginnings."""
        data = np.frombuffer(word, np.uint8)
        hashes = bytetext.words(data, np.array([0, len(data)]), bytetext.letters_table(), bytetext.fold_table(), toxicity.STEMS)[2:]
        return sum(weights.get(int(h[0]), 0.0) for h in hashes)

    for i, text in enumerate(texts):
        ends = "[" + re.escape("".join(map(chr, toxicity.ENDS))) + "]"
        sentences = [re.findall(rb"[A-Za-z\x80-\xff]+", part) for part in re.split(ends.encode(), (text or "").encode())]
        clean = 1.0
        for own in [x for x in sentences if x] or [[]]:
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(map(pull, own)))))
        assert got[i] == pytest.approx(1 - clean, abs=1e-9)
