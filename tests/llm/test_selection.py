"""Sharding, the audit of filters and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from docaudit.llm import filter_audit, queries, resampling, sharding
from test_copies import ODD, families

FOLDER = "/root/testdata/sf0.001"
TINY = "/root/testdata/sf0.01"


def documents(spark, folder):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


# Sharding


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def check_shards(rows, got, shards, text_of=None):
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_deal(rows, shards, nodes=256):
    """Shard of every text, group by group, where all groups are large and none has to be cut: by walking a list of virtual nodes."""
    from pyspark.sql import functions as F
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    texts = sorted({t or "" for _, t, *_ in rows})
    hashed = {r.t: r.h % (1 << 64) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    sizes = Counter()
    for _, t, *_ in rows:
        sizes[t or ""] += len((t or "").encode()) + 8
    points = sorted((int(hashlib.sha256(f"{s}/{i}".encode()).hexdigest()[:16], 16), s) for s in range(shards) for i in range(nodes))
    most, load, at = math.ceil(sum(sizes.values()) / shards), Counter(), {}
    for t in sorted(texts, key=lambda t: (-sizes[t], hashed[t])):
        turned = [s for p, s in points if p >= hashed[t]] + [s for p, s in points if p < hashed[t]]
        fits = [s for s in turned if load[s] + sizes[t] <= most]
        s = fits[0] if fits else min(dict.fromkeys(turned), key=lambda s: load[s])
        load[s] += sizes[t]
        at[t] = s
    return at


def test_shards_against_walk(spark, docs):
    rows = [(i, t) for i, t in enumerate(families(4, 10))]
    got = rows_of(sharding.assign(docs(rows), shards=5, over=9.0))
    check_shards(rows, got, 5)
    want = brute_deal(rows, 5)
    assert {r["doc_id"]: r["shard"] for r in got} == {i: want[t] for i, t in rows}


def test_shards_odd_rows_and_hot_group(spark, docs):
    rows = ODD + [(2000 + i, "hot " * 20) for i in range(900)] + [(5000 + i, "") for i in range(700)] + [(9000 + i, t) for i, t in enumerate(families(9, 40))]
    for shards in (1, 3):
        got = rows_of(sharding.assign(docs(rows), shards=shards))
        check_shards(rows, got, shards)
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 3
    assert rows_of(sharding.assign(docs([]))) == []


def test_registered_shards(spark):
    rows = documents(spark, TINY)
    got = rows_of(queries.RUNS["op11_shard_ring"](spark, TINY))
    check_shards(rows, got, 24)
    loads, text, shard = Counter(), dict((i, t) for i, t, _ in rows), defaultdict(set)
    for r in got:
        loads[r["shard"]] += r["size"]
        shard[text[r["doc_id"]]].add(r["shard"])
    mean = sum(loads.values()) / 24
    assert max(loads.values()) <= 1.02 * mean and min(loads.values()) >= 0.98 * mean
    assert all(len(s) == 1 for s in shard.values())
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_one_more_shard_moves_little():
    rng = random.Random(3)
    keys = [(rng.randrange(1 << 64), [rng.randint(50, 4000)]) for _ in range(6000)]
    before, after = (sharding.deal(sharding.Ring(n), keys) for n in (24, 25))
    total = sum(k[1][0] for k in keys)
    moved = sum(k[1][0] for k, a, b in zip(keys, before, after) if a != b)
    assert moved <= 0.08 * total  # 0.04 at least
    assert sum(k[1][0] for k, a, b in zip(keys, before, after) if a != b and b != [24]) <= 0.04 * total


# Filter audit


def brute_audit(rows, labels):
    """rows: doc_id, text, part; labels: doc_id, quality, toxic."""
    good, toxic = defaultdict(bool), defaultdict(bool)
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    docs = []
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        docs.append((part or "", {f for f, x in fails.items() if x}, good[i], toxic[i]))
    out = []
    for part in {d[0] for d in docs}:
        own, found = [d for d in docs if d[0] == part], []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                found.append([part, "".join(order), step, len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)])
        shapley = Counter()
        for r in found:
            shapley[r[1][r[2] - 1]] += r[4]
        out += [tuple([*r, shapley[r[1][r[2] - 1]]]) for r in found]
    return sorted(out)


def test_lehmer_ranks_and_intervals():
    orders = list(permutations(range(5)))
    assert [filter_audit.lehmer_rank(o, 5) for o in orders] == list(range(120))
    seen = defaultdict(int)
    for mask, step, lo, hi in filter_audit.removal_intervals(5):
        for rank in range(lo, hi):
            assert next(i for i, f in enumerate(orders[rank], 1) if mask >> f & 1) == step
            seen[mask, rank] += 1
    assert len(seen) == 31 * 120 and set(seen.values()) == {1}


def test_audit_against_brute_force(spark, docs):
    rng = random.Random(7)
    words = ["alpha", "Beta", "GAMMA", "d$", "é", "5%"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 6, 306])]) for _ in range(rng.choice([0, 3, 199, 200, 420]))) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["x", "y", None, ""])) for i in range(200)]
    rows += [(i, t, "x") for i, t in ODD] + [(50, rows[50][1], "z"), (3, rows[3][1], rows[3][2])] + [(1000 + i, "hot", "x") for i in range(300)]
    labels = [(rng.randrange(220), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1)]
    got = filter_audit.audit_filters(docs(rows).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_audit_of_nothing(spark, docs):
    assert filter_audit.audit_filters(docs([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


# Resampling


def brute_resample(rows, targets, share_percent=10, runs=1, buckets=10000, least=20, seed=2024):
    def found(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(found(text)[1])
    for text in targets:
        t.update(found(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out, fit = [], []
    for i, text, *_ in rows:
        words, own = found(text)
        weight = sum(map(gain, own))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(fit[: share_percent * len(fit) // 100], 1):
        r[4] = n
    return sorted(map(tuple, out), key=repr)


def test_crc_of_spans():
    rng = random.Random(1)
    texts = ["", None, "Éa 1b", "x" * 200 + " y", "a_b.c", *families(2, 3)]
    for runs in (1, 3):
        found, begins, words = resampling.features(pa.array(texts), runs, 10000)
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            assert words[i] == len(w)
            for n in range(1, runs + 1):
                want = [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for k in range(len(w) - n + 1)]
                assert found[n - 1][begins[n - 1][i] : begins[n - 1][i + 1]].tolist() == want


def test_registered_resample(spark):
    targets = [r.text for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    got = queries.RUNS["op13_resample"](spark, TINY)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(documents(spark, TINY), targets)


@pytest.mark.parametrize("runs", [1, 2])
def test_resample_odd_rows(spark, docs, runs):
    rows = ODD + [(100 + i // 2, t) for i, t in enumerate(families(6, 20))] + [(None, families(1)[0]), (-5, families(1)[0]), (7000, families(1)[0]), (7000, families(1)[0])]
    target = spark.createDataFrame([("ba la co " * 30,), (None,), ("",)], "text string")
    got = resampling.resample(docs(rows).repartition(4), target, share=0.3, runs=runs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, ["ba la co " * 30], 30, runs)


def test_resample_of_nothing(spark, docs):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(docs([]), target).collect() == []
    assert [tuple(r) for r in resampling.resample(docs([(1, None)]), target).collect()] == brute_resample([(1, None)], [])


def test_radix_places(spark):
    rng = random.Random(2)
    rows = [(rng.choice([-5, 0, 3, 1 << 40, -(1 << 63), (1 << 63) - 1, rng.randrange(10**6)]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, i long").repartition(6)
    got = resampling.radix_places(df, ["a", "b"], block_rows=256).read().orderBy("place").collect()
    assert [r.place for r in got] == list(range(3000))
    assert [(r.a, r.b) for r in got] == sorted((a, b) for a, b, _ in rows)
    assert sorted(r.i for r in got) == list(range(3000))
    same = resampling.radix_places(spark.createDataFrame([(1, 1)] * 5, "a long, b long"), ["a", "b"]).read().collect()
    assert sorted(r.place for r in same) == list(range(5))
