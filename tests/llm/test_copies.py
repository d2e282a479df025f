"""Exact dedup, line dedup and the n-gram join against brute force."""

import random
import re

import pytest
from docaudit.llm import exact_dedup, line_dedup, ngram_join

WORDS = [a + b for a in ("ba", "co", "du", "fe", "gi") for b in ("la", "mo", "nu", "pe", "ri", "so")]
ODD = [(None, "null id"), (None, "null id"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "é — ü 漢字 \U0001f600"), (7, "x" * 70_000), (8, "x" * 70_000), (9, "a b c d e"), (9, "a b c d e"), (10, "a b c d e f")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def families(seed, many=12):
    """Texts with exact copies, copies with some words changed, and a common passage."""
    rng = random.Random(seed)
    common = prose(rng, 30)
    texts = []
    for _ in range(many):
        base = prose(rng, rng.randint(5, 120)).split()
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words) + (f"\n{common}" if rng.random() < 0.3 else ""))
    return texts


def test_exact_dedup(docs):
    rows = ODD + [(100 + i, t) for i, t in enumerate(families(1))] + [(1000 + i, "same") for i in range(300)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(rows)).collect())
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in ids if j is not None), default=None)
        want.append((i is None, i or 0, keep, len(ids), i == keep))
    assert got == sorted(want)


def test_exact_dedup_carries_and_empty(spark, docs):
    from pyspark.sql import functions as F

    got = exact_dedup.exact_dedup(docs([(1, "a")]), carry={"group": F.length("text")}).collect()[0]
    assert got.group == 1 and got.kept
    assert exact_dedup.exact_dedup(docs([])).collect() == []


def brute_lines(rows, keep, least):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            found.setdefault(key(line), set()).add((i, t or ""))
    out, seen = [], set()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        left = []
        for line in (t or "").split("\n"):
            k = key(line)
            gone = len(k) >= 1 and (len(found[k]) >= least if keep == "none" else k in seen)
            seen.add(k)
            left += [] if gone else [line]
        out.append((i, "\n".join(left)))
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup(spark, docs, keep):
    rng = random.Random(5)
    lines = [prose(rng, 4) for _ in range(40)] + ["", "  ", "Common", " common\t", "É"]
    rows = [(i, "\n".join(rng.choice(lines + ["common"] * 20) for _ in range(rng.randint(1, 12)))) for i in range(250)]
    if keep == "none":
        rows += [(900, None), (901, ""), (None, "common\nown"), (902, "common\nlast")] + [(3, rows[3][1])]
    rows.append((903, "\n".join(["common", "x"] * 5000)))
    df = docs(rows).repartition(7)
    left = line_dedup.drop_lines(df, line_dedup.line_bitmaps(df, keep=keep, least_docs=10), count_as="went")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in left.collect()))
    assert got == sorted((i is not None, i or 0, t) for i, t in brute_lines(rows, keep, 10))
    assert left.columns == [*df.columns, "went"]


def test_line_dedup_runs_over_many_tasks(spark, docs):
    """A line of all documents, dealt so that its run lies in many tasks, with fewer than the asked documents in each."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = docs([(i, "all of us") for i in range(60)])
        got = line_dedup.line_bitmaps(df, least_docs=50).collect()
        assert len(got) == 60 and all(r.n_dropped == 1 for r in got)
        assert line_dedup.line_bitmaps(df, least_docs=61).collect() == []
        assert len(line_dedup.line_bitmaps(df, keep="first").collect()) == 59
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k is None, k or 0, len(sets[i]), least.get(find(i), -1)) for i, (k, _) in enumerate(rows)))


@pytest.mark.parametrize(("seed", "percent"), [(1, 80), (2, 80), (3, 60)])
def test_near_duplicates(docs, seed, percent):
    rows = ODD + [(100 + i, t) for i, t in enumerate(families(seed))]
    random.Random(seed).shuffle(rows)
    got = ngram_join.near_duplicates(docs(rows), percent=percent).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component is None else r.component) for r in got) == brute_components(rows, percent)


def test_near_duplicates_of_one_large_family(docs):
    """Many versions of one text with few to many changes: most pairs share over half of their shingles but are no links."""
    rng = random.Random(9)
    base = prose(rng, 150).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 6])):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    got = ngram_join.near_duplicates(docs(rows)).collect()
    assert sorted((False, r.doc_id, r.n_shingles, r.component) for r in got) == brute_components(rows, 80)


def test_near_duplicates_empty(docs):
    assert ngram_join.near_duplicates(docs([])).collect() == []


def test_matches_grow_with_cost():
    import numpy as np

    cheap, dear = np.ones(40), np.full(40, 5000.0)
    assert ngram_join.pick_matches(cheap, 100, 80) == 1
    assert ngram_join.pick_matches(dear, 100, 80) == ngram_join.MOST_MATCHES


