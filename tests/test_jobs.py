"""Sources and whole jobs over files."""

import json

import pytest

from pyspark.sql import functions as F

from docaudit.operators import contradictions as D
from docaudit.plans import jobs
from docaudit.sources import files, records, reports, tree


def put(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_cross_validation_of_files(spark, tmp_path):
    root = tmp_path / "out"
    put(root, "a/report.MD", "Acme Corp revenue was $1,200 on 2024-03-05.")
    put(root, "b/report.txt", b"Acme Corp revenue was $1,500 on 2024-03-06. \xff")
    put(root, "c/skip.csv", "Acme Corp revenue was 9")
    put(root, "x.claims.json", json.dumps({"claims": [{"entity": "Widget", "attribute": "numeric", "value": "100"}]}))
    put(root, "y.claims.json", json.dumps({"claims": [{"entity": "Widget", "attribute": "numeric", "value": "100.5"}]}))
    put(root, "z.claims.json", "{bad")
    texts = files.read_texts(spark, str(root))
    assert {r.path for r in texts.collect()} == {"a/report.MD", "b/report.txt"}
    found = jobs.cross_validate(texts, records.read_claims(spark, str(root)))
    assert {r.severity: int(r.n) for r in found.counts.collect()} == {"HIGH": 15, "MEDIUM": 0, "LOW": 1}
    assert found.blocked.first().blocked
    lines = reports.report_lines(found.counts, D.contested_claims(found.points), "now")
    reports.write_report(lines, str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "- HIGH: 15 findings" in text and "Do not merge" in text
    # Four numbers and a date in each report, and both values of the widget.
    assert text.count("## HIGH") == 10 and text.count("## LOW") == 2


def test_gates_of_profiles(spark, tmp_path):
    det = lambda kind, **more: {"type": kind, "mechanism": "deterministic", **more}
    profiles = {
        "one": {"quality_gates": [det("recency_check", required=True), det("lint"), det("unit_tests", required=True)]},
        "two": {"quality_gates": [{"type": "review", "mechanism": "heuristic"}]},
        "cited": {"quality_gates": [det("citation_audit", required=True)], "shared_truth": {"law": "law.md", "gone": "gone.md"}},
        "other": {"quality_gates": [det("citation_audit", required=True)], "shared_truth": {"memo": "memo.md"}},
        "unsourced": {"quality_gates": [det("citation_audit", required=True)], "shared_truth": {"gone": "gone.md"}},
        "scoped": {"quality_gates": [det("scope_validation", commit_scope=["src/"])]},
        "wide": {"quality_gates": [det("scope_validation", commit_scope=["src/", "doc"])]},
        "free": {"quality_gates": [det("scope_validation")]},
    }
    for name, profile in profiles.items():
        put(tmp_path, f"p/{name}.json", json.dumps(profile))
    docs = spark.createDataFrame([("d", "on 2020-01-01, Section 1.1 and Section 1.1")], "path string, text string")
    sources = spark.createDataFrame([("law.md", "Section 1.1"), ("memo.md", "Section 2.2")], "path string, text string")
    locales = spark.createDataFrame([], "locale_file string, json string")
    changed = spark.createDataFrame([("src/a.py",), ("doc\\b.md",)], "path string")
    logs = spark.createDataFrame([("unit_tests", 1, "2 failed"), ("unit_tests", 0, "ok")], "gate_type string, exit_code int, output string")
    listed, verdicts = jobs.run_gates(records.read_profiles(spark, str(tmp_path / "p")), docs, sources, locales, changed, F.lit("2026-12-01 00:00:00"), logs)
    got = {(r.name, r.gate_type): (r.required, r.passed, r.skipped, r.n_checked, r.n_failed) for r in listed.collect()}
    assert got == {
        ("one", "recency_check"): (True, False, False, 1, 1),
        ("one", "lint"): (False, True, True, 0, 0),
        ("one", "unit_tests"): (True, False, False, 2, 1),
        ("cited", "citation_audit"): (True, True, False, 2, 0),
        ("other", "citation_audit"): (True, False, False, 2, 2),
        ("unsourced", "citation_audit"): (True, True, True, 2, 2),
        ("scoped", "scope_validation"): (True, False, False, 2, 1),
        ("wide", "scope_validation"): (True, True, False, 2, 0),
        ("free", "scope_validation"): (True, True, True, 2, 2),
    }
    assert {r.name: r.exit_code for r in verdicts.collect()} == {"one": 1, "two": 0, "cited": 0, "other": 1, "unsourced": 2, "scoped": 1, "wide": 0, "free": 2}


def test_values_of_other_types_cost_only_themselves(spark, tmp_path):
    claim = {"entity": "Widget", "attribute": "numeric", "value": 100}
    put(tmp_path, "a.claims.json", json.dumps({"claims": [claim | {"confidence": "high"}, claim | {"value": "7"}]}))
    put(tmp_path, "b.claims.json", "[1]")
    got = records.read_claims(spark, str(tmp_path)).collect()
    assert [(r.path, [(c.value, c.confidence) for c in r.claims]) for r in got] == [("a.claims.json", [("100", None), ("7", None)])]
    put(tmp_path, "t/x/metadata.json", json.dumps({"status": "active", "github_issue": {"number": "12"}}))
    put(tmp_path, "t/y/metadata.json", json.dumps({"status": 5, "github_issue": "none"}))
    tracks = {r.track_id: (r.status, r.github_issue and r.github_issue.number, r.metadata_error) for r in records.read_tracks(spark, str(tmp_path / "t")).collect()}
    assert tracks == {"x": ("active", 12, None), "y": ("5", None, None)}


def test_only_the_own_report_is_left_out(spark, tmp_path):
    for name in ("contradiction_report.md", "contradiction_report_notes/a.md", "b/contradiction_report.md"):
        put(tmp_path, f"tmp/{tmp_path.name}/{name}", "x")
    texts = files.read_texts(spark, str(tmp_path / "tmp" / tmp_path.name))
    assert {r.path for r in texts.collect()} == {"contradiction_report_notes/a.md", "b/contradiction_report.md"}


def test_sanitized_copy(spark, tmp_path):
    put(tmp_path, "in/a.md", "SYSTEM: x\nok")
    put(tmp_path, "in/b.pdf", b"\xff\xfe")
    cleaned, summary = jobs.sanitize_files(files.read_files(spark, str(tmp_path / "in")))
    files.write_sanitized(cleaned, str(tmp_path / "clean"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "clean")).collect()] == ["ok"]
    row = summary.first()
    assert (row.n_scanned, row.n_binary, row.n_injections, row.flag) == (2, 1, 1, 1)


def test_tracks_and_comments(spark, tmp_path):
    put(tmp_path, "tracks/t_1/metadata.json", json.dumps({"status": "active", "github_issue": {"number": 3}}))
    put(tmp_path, "tracks/t_1/plan.md", "- [x] a")
    put(tmp_path, "tracks/t_2/metadata.json", "{bad")
    got = {r.track_id: (r.status, r.plan, r.metadata_error) for r in records.read_tracks(spark, str(tmp_path / "tracks")).collect()}
    assert got == {"t_1": ("active", "- [x] a", None), "t_2": (None, None, "not a JSON object")}
    put(tmp_path, "feed/i.json", json.dumps({"number": 3, "comments": [{"author": {"login": "bo"}, "body": "hi", "createdAt": "2024-01-01T00:00:00Z"}]}))
    assert [(r.issue_number, r.seq, r.author) for r in records.read_comments(spark, str(tmp_path / "feed")).collect()] == [(3, 0, "bo")]


def test_sanitized_tree(spark, tmp_path):
    rows = [("a/b.md", "one"), ("a/c/d é.txt", "zwei\n"), ("e.md", None)]
    target = tmp_path / "tree"
    tree.write_tree(spark.createDataFrame(rows, "path string, text string").repartition(3), str(target))
    read = lambda: {str(p.relative_to(target)): p.read_text() for p in target.rglob("*") if p.is_file()}
    assert read() == {"a/b.md": "one", "a/c/d é.txt": "zwei\n", "e.md": ""}
    # A task that fails leaves the old tree, and nothing beside it.
    with pytest.raises(Exception, match="not a path below the tree"):
        tree.write_tree(spark.createDataFrame([("new.md", "x"), ("../out.md", "y")], "path string, text string"), str(target))
    assert read() == {"a/b.md": "one", "a/c/d é.txt": "zwei\n", "e.md": ""}
    assert [p.name for p in tmp_path.iterdir()] == ["tree"]
    # The next one replaces it whole.
    tree.write_tree(spark.createDataFrame([("new.md", "x")], "path string, text string"), str(target))
    assert read() == {"new.md": "x"} and [p.name for p in tmp_path.iterdir()] == ["tree"]


def test_texts_in_any_case(spark, tmp_path):
    for name in ("A.MD", "b.Txt", "c/d.markdown", "e.json", "f.mdx"):
        put(tmp_path, name, name)
    assert {r.path: r.text for r in files.read_texts(spark, str(tmp_path)).collect()} == {n: n for n in ("A.MD", "b.Txt", "c/d.markdown")}


def test_poll(spark):
    schema = "track_id string, status string, description string, updated_at string, github_issue struct<number: long>, active_questions array<struct<agent: string, status: string, question: string, answer: string>>"
    waiting = ("t1", "active", "T", "u", (7,), [("a", "awaiting_human", "?", None)])
    closed = ("t2", "completed", "C", "u", (8,), [("a", "awaiting_human", "?", None)])
    feed = spark.createDataFrame(
        [(7, 0, "a", "[Question][a] why", None), (7, 1, "me", "[ANSWER][a]\nso", None), (8, 0, "a", "[Question][a] closed", None)],
        "issue_number long, seq long, author string, body string, created_at timestamp",
    )
    snapshot, tracks = jobs.poll_questions(spark.createDataFrame([waiting, closed], schema), feed, F.lit("2026-01-01 00:00:00"))
    assert [(r.issue_number, r.issue_title, r.question, r.answer) for r in snapshot.collect()] == [(7, "T", "why", "so")]
    assert {r.track_id: (r.active_questions[0].status, r.active_questions[0].answer) for r in tracks.collect()} == {"t1": ("answered", "so"), "t2": ("awaiting_human", None)}
    snapshot, tracks = jobs.poll_questions(spark.createDataFrame([closed], schema), feed, F.lit("2026-01-01 00:00:00"))
    assert snapshot.collect() == [] and tracks.first().active_questions[0].status == "awaiting_human"
