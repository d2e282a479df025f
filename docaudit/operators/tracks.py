"""Analytics over tracks: progress, freshness, attribution, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import patterns as P
from docaudit.functions.dates import parse_timestamp, relative_age
from docaudit.functions.numbers import progress_bar, whole_percent
from docaudit.functions.text import preview

STATS = ["total", "completed", "in_progress", "pending"]


def _field(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# Progress -----------------------------------------------------------------------------------------------------


def plan_counts(plans: DataFrame, plan: str = "plan") -> DataFrame:
    """G1: checkbox counts of plan texts, counted inside each text without taking its lines apart.

    Only blank, ``x`` and ``~`` mark a task; a capital X does not.
    """

    return plans.select(
        *[c for c in plans.columns if c != plan],
        *[F.regexp_count(F.col(plan), F.lit(P.CHECKBOX[c])).alias(c) for c in STATS],
    )


def task_counts(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """G2 over a table of tasks: done, active and pending per key; status is case-sensitive."""
    status = F.coalesce("status", F.lit(""))
    done, active = F.count_if(status.isin(P.DONE_TASKS)), F.count_if(status.isin(P.ACTIVE_TASKS))
    n = F.count(F.lit(1))
    return tasks.groupBy(*keys).agg(
        n.alias("total"), done.alias("completed"), active.alias("in_progress"), (n - done - active).alias("pending")
    )


def listed_counts(tasks: Column) -> Column:
    """G2 over a track's own array of tasks: counts, NULL when the list is empty."""
    size = F.size(tasks)
    done = F.size(F.filter(tasks, lambda t: F.coalesce(t["status"].isin(P.DONE_TASKS), F.lit(False))))
    active = F.size(F.filter(tasks, lambda t: F.coalesce(t["status"].isin(P.ACTIVE_TASKS), F.lit(False))))
    return F.when(
        size > 0,
        F.struct(
            size.alias("total"), done.alias("completed"), active.alias("in_progress"),
            (size - done - active).alias("pending"),
        ),
    )


def progress(stats: DataFrame) -> DataFrame:
    """Percentage, bar and ratio of counted tasks."""
    return (
        stats.withColumn("percent", whole_percent(F.col("completed"), F.col("total")))
        .withColumn("bar", progress_bar(F.col("percent")))
        .withColumn(
            "ratio",
            F.when(F.col("total").isNotNull(), F.concat(F.col("completed").cast("string"), F.lit("/"), F.col("total").cast("string"))).otherwise(
                "N/A"
            ),
        )
    )


# Freshness ----------------------------------------------------------------------------------------------------


def effective_time(remote: Column, updated: Column, last_changed: Column, file_time: Column) -> Column:
    """The later of remote and local change and its origin; a tie is remote.

    Local is ``updated_at``, else ``last_changed``, and the file time when neither gives a time.
    """
    local = F.coalesce(parse_timestamp(F.coalesce(_given(updated), last_changed)), file_time)
    use_remote = remote.isNotNull() & (local.isNull() | (remote >= local))
    return F.when(
        F.coalesce(remote, local).isNotNull(),
        F.struct(
            F.when(use_remote, remote).otherwise(local).alias("time"),
            F.when(use_remote, "remote").otherwise("local").alias("origin"),
        ),
    )


def newest_first(tracks: DataFrame, time: str = "effective_time") -> DataFrame:
    """Newest change first, tracks without one as of 1970; ties by name."""
    return tracks.orderBy(F.coalesce(F.col(time), F.timestamp_seconds(F.lit(0))).desc(), "track_id")


def is_open(status: Column) -> Column:
    """G8"""
    return ~status.isin(P.CLOSED_TRACKS)


# Attribution --------------------------------------------------------------------------------------------------


def worktree_index(directories: DataFrame, directory: str = "directory") -> tuple[DataFrame, DataFrame]:
    """Agents of worktree directories ``issue-<id>-<agent>``, by issue number and by name; the last wins."""
    d = F.col(directory)
    parsed = directories.select(
        d.alias("dir"),
        F.regexp_extract(d, P.WORKTREE_DIRECTORY, 1).alias("id"),
        F.regexp_extract(d, P.WORKTREE_DIRECTORY, 2).alias("dir_agent"),
    ).where(F.col("id") != "")
    numeric = F.rlike("id", F.lit(r"(?U)^\d+$"))
    newest = F.max_by("dir_agent", "dir").alias("dir_agent")
    return (
        parsed.where(numeric).groupBy("id").agg(newest),
        parsed.where(~numeric).groupBy("id").agg(newest),
    )


def _first_named(items: Column) -> Column:
    """The first non-empty agent in an array of questions or tasks."""
    name = lambda q: F.coalesce(*[_given(q[k]) for k in P.AGENT_KEYS])
    return F.get(F.filter(F.transform(items, name), lambda a: a.isNotNull()), F.lit(0))


def _or_alone(key: Column) -> Column:
    """The key, or where there is none one that matches nothing and differs by track, so that such tracks do not meet in one task."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("\0"), F.col("track_id")))


def attribute(tracks: DataFrame, directories: DataFrame) -> DataFrame:
    """The agent of each track and whether it has a worktree.

    The agent comes from the metadata, its questions, its tasks, a directory for its issue, a directory for its
    name, or the directory recorded in it, whichever is first to name one.
    """
    by_issue, by_name = worktree_index(directories)
    slug = F.replace(F.col("track_id"), F.lit("_"), F.lit("-"))
    existing = directories.select(F.col("directory").alias("_recorded")).distinct().withColumn("_exists", F.lit(True))
    base = lambda p: F.regexp_extract(p, r"([^/\\]+)$", 1)
    recorded_dir, recorded_path = F.col("worktree.directory"), F.col("worktree.path")
    keyed = (
        tracks.withColumn("_issue", _or_alone(F.nullif(F.col("github_issue.number"), F.lit(0))))
        .withColumn("_slug", slug)
        .withColumn("_short", F.regexp_replace("_slug", P.DATED_SUFFIX, ""))
    )
    joined = (
        keyed.join(by_issue.select(F.col("id").alias("_issue"), F.col("dir_agent").alias("_a1")), "_issue", "left")
        .join(by_name.select(F.col("id").alias("_slug"), F.col("dir_agent").alias("_a2")), "_slug", "left")
        .join(by_name.select(F.col("id").alias("_short"), F.col("dir_agent").alias("_a3")), "_short", "left")
        .join(
            existing.select(F.col("_recorded").alias("_d"), F.col("_exists").alias("_e1")),
            F.col("_d") == _or_alone(base(recorded_dir)),
            "left",
        )
        .join(
            existing.select(F.col("_recorded").alias("_p"), F.col("_exists").alias("_e2")),
            F.col("_p") == _or_alone(base(recorded_path)),
            "left",
        )
    )
    noted = base(F.coalesce(_given(recorded_path), recorded_dir))
    agent = F.coalesce(
        *[_given(_field(tracks, k)) for k in P.AGENT_KEYS],
        _first_named(F.col("active_questions")),
        _first_named(F.col("tasks")),
        F.col("_a1"),
        F.col("_a2"),
        F.col("_a3"),
        _given(F.regexp_extract(noted, P.WORKTREE_DIRECTORY, 2)),
    )
    found = reduce(Column.__or__, [F.col(c).isNotNull() for c in ("_e1", "_e2", "_a1", "_a2", "_a3")])
    return joined.select(*[F.col(c) for c in tracks.columns if c not in P.AGENT_KEYS], agent.alias("track_agent"), found.alias("has_worktree"))


def worktree_status(worktrees: DataFrame, tracks: DataFrame, name: str = "directory") -> DataFrame:
    """Worktrees with the metadata of the track before their first dash, questions as previews."""
    meta = tracks.select(
        "track_id",
        F.coalesce("agent", F.lit("Unknown")).alias("agent"),
        F.coalesce("status", F.lit("Unknown")).alias("status"),
        F.transform(
            "active_questions",
            lambda q: F.concat(
                F.lit("["), F.coalesce(q["status"], F.lit("unknown")), F.lit("] "), preview(q["question"])
            ),
        ).alias("questions"),
        F.lit(True).alias("has_metadata"),
    )
    return worktrees.withColumn("track_id", F.substring_index(F.col(name), "-", 1)).join(
        meta, "track_id", "left"
    ).withColumn("has_metadata", F.coalesce("has_metadata", F.lit(False)))


# Registry -----------------------------------------------------------------------------------------------------


def registry(
    tracks: DataFrame,
    directories: DataFrame,
    issues: DataFrame,
    as_of: Column,
    open_only: bool = False,
) -> DataFrame:
    """The track listing: status, agent, progress, age. ``issues`` holds (number, updated_at text)."""
    remote = issues.select(
        F.col("number").cast("string").alias("_number"), parse_timestamp(F.col("updated_at")).alias("_remote")
    )
    by_plan = F.when(
        F.col("plan").isNotNull(),
        F.struct(*[F.col(f"_plan.{c}").cast("int").alias(c) for c in STATS]),
    )
    plans = plan_counts(tracks.select("track_id", "plan").where(F.col("plan").isNotNull()))
    error = _field(tracks, "metadata_error")
    status = F.when(
        error.isNotNull(), F.concat(F.lit("METADATA_ERROR ("), error, F.lit(")"))
    ).otherwise(F.upper(F.coalesce("status", F.lit("unknown"))))
    merged = (
        attribute(tracks, directories)
        .join(remote, _or_alone(F.col("github_issue.number")) == F.col("_number"), "left")
        .join(plans.select("track_id", F.struct(*STATS).alias("_plan")), "track_id", "left")
        .withColumn("_stats", F.coalesce(listed_counts(F.col("tasks")), by_plan))
        .withColumn(
            "_changed",
            effective_time(
                F.col("_remote"),
                _field(tracks, "updated_at"),
                _field(tracks, "last_changed"),
                _field(tracks, "file_time", "timestamp"),
            ),
        )
    )
    shaped = progress(
        merged.select(
            "track_id",
            status.alias("status"),
            F.coalesce("description", F.lit("No description")).alias("description"),
            F.col("track_agent").alias("agent"),
            "has_worktree",
            F.col("github_issue.number").alias("issue_number"),
            *[F.col(f"_stats.{c}").alias(c) for c in STATS],
            F.col("_changed.time").alias("effective_time"),
            F.col("_changed.origin").alias("origin"),
            F.coalesce(relative_age(F.col("_changed.time"), as_of.cast("timestamp")), F.lit("-")).alias("age"),
        )
    )
    return shaped.where(is_open(F.col("status"))) if open_only else shaped


def totals(listing: DataFrame) -> DataFrame:
    """Tracks done and open, task ratio (``N/A`` without any counts), worktrees."""
    closed = ~is_open(F.col("status"))
    ratio = F.when(
        F.count("total") > 0,
        F.concat(F.sum("completed").cast("string"), F.lit("/"), F.sum("total").cast("string")),
    ).otherwise("N/A")
    return listing.agg(
        F.count_if(closed).alias("n_completed"),
        F.count_if(~closed).alias("n_open"),
        F.count(F.lit(1)).alias("n_tracks"),
        ratio.alias("task_ratio"),
        F.count_if("has_worktree").alias("n_worktrees"),
    )


def insert_tasks(tasks: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds a pending task ``ghi_<number>`` for each (track_id, number, title, url) not yet present."""
    new = issues.select(
        "track_id",
        F.concat(F.lit("ghi_"), F.col("number").cast("string")).alias("task_id"),
        F.col("title").alias("description"),
        F.lit("pending").alias("status"),
        F.col("url").alias("github_issue_url"),
    ).dropDuplicates(["track_id", "task_id"])
    added = new.join(tasks.select("track_id", "task_id"), ["track_id", "task_id"], "left_anti")
    return tasks.unionByName(added, allowMissingColumns=True)


def latest_track(tracks: DataFrame, time: str = "file_time") -> DataFrame:
    """The track whose metadata changed last."""
    return tracks.agg(F.max_by("track_id", F.struct(F.col(time), "track_id")).alias("track_id"))
