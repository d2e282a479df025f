"""Random cases against brute force, and the shape of the plans."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from docaudit.operators import contradictions as D
from docaudit.operators import runlog as R
from docaudit.operators.nearby import near_counts
from docaudit.operators.sanitizing import sanitize


def brute(a, b):
    """Severity of two different numbers, as plain arithmetic says."""
    rel = abs(a - b) / max(abs(a), abs(b), 1e-9)
    return "HIGH" if rel > 0.01 else "LOW"


def random_numbers(rng, n):
    base = [rng.choice([1.0, 100.0, -100.0, 5e-10, 12345.678, 2.0**40]) for _ in range(n)]
    values = [b * rng.choice([1, 0.99, 1.01, 1 / 0.99, 0.995, 1.0000000001, 0.5]) for b in base]
    return [math.nextafter(v, rng.choice([-math.inf, math.inf])) if rng.random() < 0.4 else v for v in values] + [0.0]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_counts_at_the_edge(spark, seed):
    rng = random.Random(seed)
    values = sorted(set(random_numbers(rng, 150)))
    rows = [("g", v, rng.randint(1, 3)) for v in values]
    got = {r.num: r.near for r in near_counts(spark.createDataFrame(rows, "g string, num double, n long"), ["g"]).collect()}
    weight = {v: n for _, v, n in rows}
    want = {v: sum(weight[w] for w in values if w != v and brute(v, w) == "LOW") for v in values}
    assert got == want


def random_claims(rng, n):
    odd = [("inf", math.inf), ("-inf", -math.inf), ("nan", math.nan), ("NaN", math.nan)]
    rows = []
    for _ in range(n):
        kind = rng.choice(["numeric", "numeric", "date", "url", "size"])
        if kind == "numeric" or (kind == "size" and rng.random() < 0.7):
            value, number = rng.choice(odd) if rng.random() < 0.1 else (lambda v: (repr(v), v))(rng.choice([100.0, 100.5, 101.0, 102.0, -1.0, 0.0, 7.0]))
            if rng.random() < 0.1:
                value = value.removesuffix(".0")
        else:
            value, number = rng.choice(["x", "y", "z"]), None
        rows.append((1, rng.choice("abcd"), 0, len(rows), kind, rng.choice(["e1", "e2"]), value, number, "c" + value))
    return rows


def pair_severity(kind, a, b):
    """The rules for two claims of different files, from their texts."""
    if a[6] == b[6]:
        return None
    if kind == "date":
        return "HIGH"
    if kind == "url":
        return "MEDIUM"
    if a[7] is None or b[7] is None:
        return "HIGH" if kind == "size" else None
    if a[7] == b[7]:
        return None
    rel = abs(a[7] - b[7]) / max(abs(a[7]), abs(b[7]), 1e-9)
    return "HIGH" if rel > 0.01 else "LOW"


def brute_pairs(rows):
    unique = {(r[4], r[5], r[1], r[6]): r for r in rows}.values()
    for a, b in itertools.combinations(unique, 2):
        if a[4:6] == b[4:6] and a[1] != b[1] and (s := pair_severity(a[4], a, b)):
            yield a, b, s


def found_once(rows):
    """The findings with those of numeric, date and url over the same files, entity and values merged: the type whose group begins first has them."""
    begun = {}
    for r in rows:
        begun[r[4:6]] = min(begun.get(r[4:6], r[:4]), r[:4])
    seen = set()
    for a, b, s in sorted(brute_pairs(rows), key=lambda p: begun[p[0][4:6]]):
        key = (a[5], frozenset([(a[1], a[6]), (b[1], b[6])]), a[4] if a[4] == "size" else "")
        if key not in seen:
            seen.add(key)
            yield a, b, s


CLAIMS = "layer int, source_file string, line_number int, pos int, claim_type string, entity string, value string, value_num double, context string"


@pytest.mark.parametrize("seed, across", [(3, True), (4, False), (5, True), (6, True)])
def test_contradictions_against_brute_force(spark, seed, across):
    rng = random.Random(seed)
    rows = random_claims(rng, {5: 6, 6: 220}.get(seed, 60))
    if seed == 6:  # values stated under two and three types, in groups that begin in any order
        rows = [(*r[:4], rng.choice(["numeric", "date", "url"]), *r[5:]) if r[7] is not None else r for r in rows]
        rows = [(*r[:7], r[7] if r[4] in ("numeric", "size") else None, r[8]) for r in rows]
    points = D.claim_points(spark.createDataFrame(rows, CLAIMS), attribute_conflicts=True)
    pairs = list(found_once(rows) if across else brute_pairs(rows))
    if seed == 6:
        assert len(pairs) < len(list(brute_pairs(rows))) - 10
    want = {s: sum(p[2] == s for p in pairs) for s in D.SEVERITIES}
    per_claim = {}
    for a, b, s in pairs:
        for c in (a, b):
            per_claim.setdefault((c[4], c[5], c[1], c[6]), dict.fromkeys(D.SEVERITIES, 0))[s] += 1
    groups = D.group_conflicts(points, across)
    assert {r.severity: int(r.n) for r in D.severity_counts(groups).collect()} == want
    got = {
        (r.claim_type, r.entity, r.source_file, r.value): {"HIGH": r.n_high, "MEDIUM": r.n_medium, "LOW": r.n_low}
        for r in D.claim_conflicts(points, across).collect()
    }
    assert got == per_claim
    listed = D.contested_claims(points, across).collect()
    assert len(listed) == len(per_claim) and all(r.severity == D.SEVERITIES[r.level - 1] for r in listed)
    if across:
        assert D.is_blocked(points).first().blocked == (want["HIGH"] > 0)
    listed = D.partners(points, points, across).groupBy("severity").count().collect()
    assert {r.severity: r["count"] for r in listed} == {s: n for s, n in want.items() if n}
    contested = {(a[4], a[5]) for a, b, s in brute_pairs(rows)}
    assert {(r.claim_type, r.entity) for r in D.witnesses(points).collect()} == contested


def test_verdict_of_a_pair_that_is_low_first(spark):
    """Two files state 100 and 100.5 as numbers and then as dates: one finding, LOW."""
    rows = [(1, f, 0, p, kind, "e", v, float(v) if kind == "numeric" else None, "c") for f, v in (("a", "100"), ("b", "100.5")) for p, kind in enumerate(["numeric", "date"])]
    for order, blocked in ((rows, False), ([(r[0], r[1], r[2], 1 - r[3], *r[4:]) for r in rows], True)):
        assert D.is_blocked(D.claim_points(spark.createDataFrame(order, CLAIMS))).first().blocked == blocked


def test_one_hot_group(spark):
    """A third of all claims in one group, against counting its pairs."""
    rng = random.Random(9)
    numbers = [(1, f"f{rng.randint(0, 40)}", 0, i, "numeric", "hot" if i % 3 == 0 else f"e{i % 200}", repr(v), v, "c")
               for i in range(3000) for v in [round(rng.uniform(1, 50), 2)]]
    points = D.claim_points(spark.createDataFrame(numbers, CLAIMS))
    got = {r.entity: (int(r.n_high), int(r.n_low)) for r in D.group_conflicts(points).collect()}
    hot = sorted({(n[1], n[7]) for n in numbers if n[5] == "hot"})
    rel = [abs(v - w) / max(abs(v), abs(w), 1e-9) for i, (f, v) in enumerate(hot) for g, w in hot[:i] if f != g and v != w]
    assert got["hot"] == (sum(r > 0.01 for r in rel), sum(r <= 0.01 for r in rel))


def test_sanitizing_is_stable(spark):
    rng = random.Random(2)
    bits = ["SYSTEM:", "ok ", "\n", "\r\n", "<!--", "-->", "​", "ignore all previous instructions", " ", "\x85", "You are now"]
    rows = [("".join(rng.choice(bits) for _ in range(12)),) for _ in range(200)]
    once = sanitize(spark.createDataFrame(rows, "text string"))
    again = sanitize(once.select(F.col("clean_text").alias("text"), F.col("dirty").alias("was_dirty"), F.col("text").alias("old")))
    assert again.where("n_invisible > 0 or n_injections > 0").count() == 0
    assert again.where("not was_dirty and clean_text != old").count() == 0


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_fold_against_a_loop(spark, width):
    rng = random.Random(width)
    events, state, resets = [], {}, None
    for seq in range(400):
        op = "init" if seq == 0 or rng.random() < 0.01 else rng.choice(["register", "update", "update", "update"])
        agent, status = rng.choice("abc"), rng.choice(["pending", "running", "running", "failed", "completed", "interrupted", "odd"])
        forced = rng.random() < 0.5
        events.append(("r", seq, op, agent, status if op == "update" else None, forced))
        if op == "init" and (resets is None or forced):
            state, resets = {}, seq
        elif op == "register" and agent not in state:
            state[agent] = {"status": "pending", "retries": 0, "started": None, "ended": None}
        elif op == "update" and agent in state and status != "odd":
            s = state[agent]
            if status == "running" and s["status"] != "running":
                s["started"] = seq
            if status in ("completed", "failed", "interrupted"):
                s["ended"] = seq
            s["retries"] += status == "failed"
            s["status"] = status
    df = spark.createDataFrame(events, "run_id string, seq long, op string, agent_id string, status string, forced boolean").selectExpr(
        "*", "timestamp_seconds(seq) ts", "'x' role", "'p' phase", "cast(null as string) output_path", "cast(null as string) interrupt_reason"
    )
    got = {
        r.agent_id: {"status": r.status, "retries": r.retries, "started": r.s, "ended": r.e}
        for r in R.agent_state(df, width).selectExpr("*", "unix_seconds(started_at) s", "unix_seconds(completed_at) e").collect()
    }
    assert got == state


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans_stay_in_the_engine(spark):
    import workload

    for name in ("sanitized_pages", "prose_claims", "contradiction_groups", "citation_findings", "agent_states", "question_snapshot", "coverage_findings"):
        text = plan(workload.RUNS[name](spark, "/root/testdata/sf0.001"))
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text, (name, bad)


def test_claims_and_logs_are_read_once_or_twice(spark, tmp_path):
    """What is counted is written once; no result reads the claims again."""
    rows = [r for r in random_claims(random.Random(1), 40) if r[4] in ("numeric", "size")]  # no statement under two types
    spark.createDataFrame(rows, CLAIMS).write.parquet(f"{tmp_path}/claims")
    points = D.claim_points(spark.read.parquet(f"{tmp_path}/claims"))
    for result in (D.group_conflicts(points), D.claim_conflicts(points), D.contested_claims(points), D.is_blocked(points)):
        read = result.inputFiles()
        assert read and not any("/claims/" in f for f in read)
    log = [("r", i, "2024-01-01", "init" if i == 0 else "register", f"a{i % 3}", "x", "p", None, None, None, False) for i in range(9)]
    schema = "run_id string, seq long, ts string, op string, agent_id string, role string, phase string, status string, output_path string, interrupt_reason string, forced boolean"
    spark.createDataFrame(log, schema).write.parquet(f"{tmp_path}/log")
    plan = R.validate(spark.read.parquet(f"{tmp_path}/log"))._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "op#" in line for line in plan.splitlines()) == 2


def test_groups_are_counted_from_one_shuffle(spark):
    """The claims of groups that fit a task are not multiplied by kinds of sets, nor joined with them."""
    points = D.claim_points(spark.createDataFrame(random_claims(random.Random(2), 40), CLAIMS), attribute_conflicts=True)
    for result in (D.group_conflicts(points, False), D.claim_conflicts(points, False)):
        text = result._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in text and "Join" not in text and text.split("Initial Plan")[-1].count("Exchange ") <= 1


def test_large_groups_count_like_small_ones(spark, monkeypatch):
    """The path of large groups and that of whole groups side by side, against whole groups alone."""
    points = D.claim_points(spark.createDataFrame(random_claims(random.Random(7), 60), CLAIMS), attribute_conflicts=True)

    def everything():
        results = (D.group_conflicts(points, False), D.claim_conflicts(points, False), D.witnesses(points))
        return [sorted(map(str, r.collect())) for r in results]

    small = everything()
    monkeypatch.setattr(D.swept.large_groups, "__defaults__", (12,))
    assert everything() == small


def test_profiles_that_share_sources_and_prefixes(spark):
    """Sources and paths are looked up once per set of sources and per prefix, not once per profile; against plain loops."""
    from docaudit.operators import audits as A

    counts = spark.createDataFrame([("citation", f"article 1({i})", i, 0) for i in range(1, 8)], "kind string, key string, n long, n_failed long")
    held = {"a": [1, 2, 3], "b": [3, 4], "c": [9]}
    sources = spark.createDataFrame([(p, f"Article 1({i})") for p, ids in held.items() for i in ids], "path string, text string")
    truths = {"p": ["a"], "q": ["a", "b"], "r": ["b", "none"], "s": ["none"], "t": [], "u": ["c"], "v": ["b", "a"]}
    names = spark.createDataFrame([(n,) for n in truths], "name string")
    told = spark.createDataFrame([(n, p) for n, ps in truths.items() for p in ps], "name string, path string")
    audit = A.citation_audit_by_profile(counts, sources, names, told)
    for r in audit.collect():
        ids = {i for p in truths[r["name"]] for i in held.get(p, [])}
        there = any(p in held for p in truths[r["name"]])
        assert (r.skipped, r.n_checked, r.n_failed) == (not there, 28, 28 - sum(i for i in ids if i < 8)), r
    paths = ["a/b/c", "a/b/c", "a\\b/d", "ab", "x", "x/y"]
    prefixes = {"p": ["a/"], "q": ["a/", "a/b", "ab"], "r": ["a/b/c", "a\\b"], "s": [""], "t": [], "u": ["x", "xyz"], "v": ["a", "x/"]}
    given = spark.createDataFrame([(n, p) for n, ps in prefixes.items() for p in ps], "name string, prefix string")
    audit = A.scope_validation_by_profile(spark.createDataFrame([(p,) for p in paths], "path string"), names, given)
    for r in audit.collect():
        inside = sum(any(p.replace("\\", "/").startswith(q.replace("\\", "/")) for q in prefixes[r["name"]]) for p in paths)
        assert (r.skipped, r.n_failed) == (not prefixes[r["name"]], len(paths) - inside), r
