"""Mixing of sources and sampled segmentations."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from docaudit.llm import source_mixing as M
from docaudit.llm import subword_sampling as S
from docaudit.llm.queries import MODEL


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        above = {s: most * sizes[s] for s in free if level * weight[s] > most * sizes[s]}
        if not above:
            return capped | {s: level * weight[s] for s in free}
        capped |= above


@pytest.mark.parametrize("counts", [{"a": 300, "b": 20, "c": 5, None: 40}, {"a": 1, "b": 500, "Z": 3, "é": 2}, {"only": 30}])
def test_mixing(docs, counts):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" * int(n)), s) for i, (s, n) in enumerate((s, rng.integers(1, 60)) for s, k in counts.items() for _ in range(k))]
    rows += [(900, None, "a"), (901, "", "b"), (None, "x y", "only"), (None, "x y", "only"), (7, "seven", "nothing new")]
    got = M.mixing_plan(docs(rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken, largest = Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * largest[s] + 1
    again = M.mixing_plan(docs(rows).repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = M.mix(docs(rows))
    assert mixed.columns == docs(rows).columns
    assert mixed.count() == sum(r.copies for r in got)


def test_mixing_empty(docs):
    assert M.mix(docs([])).collect() == []
    assert [r.copies for r in M.mixing_plan(docs([(1, None), (2, " ")])).collect()] == [0, 0]


@pytest.fixture(scope="module")
def vocabulary():
    return S.vocabulary(MODEL)


def paths(v, text):
    known = {v.data[v.starts[i] : v.starts[i + 1]].tobytes(): i for i in range(259, len(v.weights))}

    def walk(b):
        if not b:
            yield ()
        for k in range(1, len(b) + 1):
            if (i := known.get(b[:k])) is not None:
                for rest in walk(b[k:]):
                    yield (i, *rest)

    weights = {p: math.exp(sum(v.weights[i] for i in p)) for p in walk(b" " + text.encode())}
    total = sum(weights.values())
    return {p: w / total for p, w in weights.items()}


def test_samples_have_the_distribution_of_draws_without_replacement(vocabulary):
    want, n = paths(vocabulary, "the cat"), 4000
    found = list(S.sample_batch(vocabulary, pa.array(["the cat"] * n), np.arange(n), 3, 1))
    first, second = (Counter(tuple(r[k][0].tolist()) for r in found) for k in (0, 1))
    for p in sorted(want, key=want.get)[-4:]:
        assert first[p] / n == pytest.approx(want[p], abs=0.03)
        assert second[p] / n == pytest.approx(sum(want[a] * want[p] / (1 - want[a]) for a in want if a != p), abs=0.03)
    for r in found[:200]:
        assert len({tuple(x[0].tolist()) for x in r}) == 3
        for ids, log, chance in r:
            assert math.exp(log) == pytest.approx(want[tuple(ids.tolist())], rel=1e-6) and 0 < chance <= 1
    # Weighing by inclusion gives an estimate of one without bias.
    assert np.mean([sum(math.exp(log) / chance for _, log, chance in r) for r in found]) == pytest.approx(1, abs=0.02)


def test_all_paths_when_there_are_few(vocabulary):
    want = paths(vocabulary, "ab")
    found = list(S.sample_batch(vocabulary, pa.array(["ab"]), np.array([3]), 50, 0))[0]
    assert {tuple(x[0].tolist()) for x in found} == set(want) and all(x[2] == 1.0 for x in found)


def test_round_trips_and_rows(spark, docs):
    texts = [None, "", " ", "  two  blanks ", "\n\nlines\r\n\t", "▁ itself", "é漢字\U0001f600", "x" * 30_000, "word " * 3000, "<s> </s> <0x41> <unk>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "none"), (None, "none")]
    got = S.encode(docs(rows), MODEL, samples=3)
    found = got.collect()
    assert all(r.round_trip for r in found) and {r.sample for r in found} == {1, 2, 3}
    spelled = S.decode(got, MODEL).collect()
    assert {r.doc_id: r.text for r in spelled if r.doc_id is not None} == {i: t or "" for i, t in enumerate(texts)}
    again = {(r.doc_id, r.sample): (r.pieces, r.log_prob, r.inclusion) for r in S.encode(docs(rows).repartition(6), MODEL, samples=3).collect()}
    for r in found:
        pieces, log, chance = again[r.doc_id, r.sample]
        assert r.pieces == pieces and (r.log_prob, r.inclusion) == pytest.approx((log, chance), rel=1e-12)
    assert S.encode(docs([]), MODEL).collect() == []
