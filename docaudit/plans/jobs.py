"""Whole workflows from end to end, each as lazily planned DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.operators import audits, claims, contradictions, questions, runlog, sanitizing
from docaudit.sources.records import deterministic_gates
from docaudit.sources.shared import written


@dataclass
class CrossValidation:
    points: DataFrame
    groups: DataFrame
    counts: DataFrame
    witnesses: DataFrame
    blocked: DataFrame


def cross_validate(
    docs: DataFrame,
    claim_files: DataFrame,
    attribute_conflicts: bool = False,
    url_context_conflicts: bool = False,
) -> CrossValidation:
    """Claims of both layers, their contradictions in numbers, one example per contested group, the verdict."""
    every = claims.all_claims(claims.structured_claims(claim_files), claims.text_claims(docs))
    points = contradictions.claim_points(every, attribute_conflicts, url_context_conflicts)
    groups = contradictions.group_conflicts(points)
    return CrossValidation(
        points,
        groups,
        contradictions.severity_counts(groups),
        contradictions.witnesses(points),
        contradictions.is_blocked(points),
    )


def sanitize_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classified files: sanitised texts and the summary of the run, binaries counted but passed through."""
    classed = sanitizing.classify_files(files)
    cleaned = sanitizing.sanitize(classed.where(F.col("kind") == "text"))
    binaries = classed.agg(F.count_if(F.col("kind") == "binary").alias("n_binary"))
    summary = sanitizing.summarize(cleaned).withColumn("n_binary", binaries.scalar())
    return cleaned, summary.withColumn("n_scanned", F.col("n_scanned") + F.col("n_binary"))


def run_gates(
    profiles: DataFrame,
    docs: DataFrame,
    sources: DataFrame,
    locales: DataFrame,
    changed: DataFrame,
    as_of: Column,
    logs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results of the gates each profile lists, with its own sources and allowed folders, and the verdict per profile.

    ``profiles`` comes from ``read_profiles``; ``sources`` (path, text) holds the files that ``shared_truth`` names,
    ``changed`` (path) the changed files, ``logs`` (gate_type, exit_code, output) the logs of tests and linters. What is
    found in documents is found once for all profiles. Gates without an audit or log are skipped; a profile without
    deterministic gates passes with the label ``no_gates``.
    """
    gates = deterministic_gates(profiles)
    keyed = audits.locale_keys(locales)
    # The documents are read here, once; what is kept is one row per distinct citation.
    counts = written(audits.mention_counts(docs, as_of), "mentions")
    common = [
        audits.mention_gates(counts, sources).where("gate_type <> 'citation_audit'"),
        audits.string_coverage(audits.coverage_findings(keyed)),
    ]
    if logs is not None:
        common.append(audits.log_gates(logs))
    results = common[0]
    for one in common[1:]:
        results = results.unionByName(one)
    names = profiles.select("name")
    own = audits.citation_audit_by_profile(counts, sources, names, profiles.select("name", F.explode(F.map_values("shared_truth")).alias("path")))
    scopes = gates.where(F.col("gate_type") == "scope_validation").select("name", F.explode("commit_scope").alias("prefix"))
    own = own.unionByName(audits.scope_validation_by_profile(changed, names, scopes))
    wide = ["passed", "skipped", "n_checked", "n_failed", "details"]
    asked = gates.select("name", "ord", "gate_type", "required")
    shared = asked.join(results.drop("required"), "gate_type", "left")
    mine = asked.join(own, ["name", "gate_type"]).select("name", "ord", *[F.col(c).alias(f"own_{c}") for c in wide])
    listed = (
        shared.join(mine, ["name", "ord"], "left")
        .select("name", "ord", "gate_type", "required", *[F.coalesce(f"own_{c}", c).alias(c) for c in wide])
        .withColumn("details", F.coalesce("details", F.concat(F.lit("no audit for this gate: "), F.col("gate_type"))))
        .na.fill({"passed": True, "skipped": True, "n_checked": 0, "n_failed": 0})
    )
    verdicts = names.join(audits.verdict(listed, ["name"]), "name", "left")
    return listed, verdicts.na.fill({"verdict": "no_gates", "exit_code": 0}).na.fill(0)


def poll_questions(tracks: DataFrame, comments: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """One poll: the snapshot of questions of the issues that tracks wait for, and the tracks with what was answered.

    Only the feeds of these issues are read. Nothing awaiting gives an empty snapshot and the tracks as they are.
    """
    waiting = questions.issues_awaiting(tracks)
    feed = comments.join(waiting.select("issue_number"), "issue_number", "left_semi")
    answered = questions.answer_tracks(tracks, questions.first_answers(feed), as_of)
    return questions.question_snapshot(feed, waiting), answered


def resume_runs(
    events: DataFrame, runs: DataFrame, profiles: DataFrame, width: int = runlog.WIDTH
) -> tuple[DataFrame, DataFrame]:
    """Status of every run and the agents to dispatch again. ``runs`` holds (run_id, profile)."""
    agents = runlog.agent_state(events, width)
    limited = runlog.with_limits(agents, runs, profiles)
    strategies = runs.join(
        profiles.select(F.col("name").alias("profile"), F.col("strategy").alias("_strategy")), "profile", "left"
    )
    status = runlog.run_status(strategies, agents, F.col("_strategy")).drop("_strategy")
    return status, runlog.resumable(limited)
