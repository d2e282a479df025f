"""Track analytics: customers as tracks, their orders as tasks, suppliers as worktree directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.functions.dates import parse_timestamp, relative_age
from docaudit.operators import tracks as G
from docaudit.schemas import QUESTION, TASK
from workload.common import longs, table, text

AS_OF = "2003-09-01 12:00:00"


def _plans(spark, d):
    """One plan per order, with a box for the order, one for its customer and lines that are no task."""
    o = table(spark, d, "orders")
    mark = F.when(F.col("o_orderstatus") == "F", "x").when(F.col("o_orderstatus") == "P", "~").otherwise(" ")
    second = F.get(F.array(*map(F.lit, ["x", "X", "~", " "])), F.col("o_custkey").cast("int") % 4)
    return o.select(
        "o_orderkey",
        text("# Plan\n- [", mark, "] ship\r\n  -\t[", second, "] pay\n* [x] no\n-[x] no\n\n - [x] plan").alias("plan"),
    )


def plan_progress(spark, d):
    return longs(G.progress(G.plan_counts(_plans(spark, d))), *G.STATS)


def _tasks(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "active").otherwise("Open")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("task_id"), status.alias("status")
    )


def task_progress(spark, d):
    return G.progress(G.task_counts(_tasks(spark, d), ["track_id"]))


def effective_changes(spark, d):
    o = table(spark, d, "orders")
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    remote = F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
        k == 1, F.date_format(t, "yyyy-MM-dd'T03:04:05+02:00'")
    )
    local = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy/MM/dd 01:00:00")).when(
        k == 2, F.date_format(t, "yyyyMMdd")
    )
    changed = G.effective_time(parse_timestamp(remote), local, F.lit(None).cast("string"), F.when(k == 3, t - F.expr("INTERVAL 5 MINUTES")))
    later = F.make_dt_interval(secs=(F.col("o_custkey") * 37 % 100000 - 60).cast("decimal(18,6)"))
    return o.select("o_orderkey", "o_custkey", changed.alias("c")).select(
        "o_orderkey",
        F.col("c.time").alias("changed"),
        F.col("c.origin").alias("origin"),
        relative_age(F.col("c.time"), F.col("c.time") + later).alias("age"),
    )


def _named(fields, **values):
    return F.struct(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _customer_tracks(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    status = F.get(F.array(*map(F.lit, ["completed", "active", "pending", "Closed", "resolved"])), F.col("c_nationkey") % 5)
    box = F.when(k % 2 == 0, "x").otherwise("~")
    return c.select(
        text("fix_", k, F.when(k % 3 == 0, "_20260604").otherwise("")).alias("track_id"),
        status.alias("status"),
        F.col("c_name").alias("description"),
        F.when(k % 11 == 0, F.col("c_mktsegment")).alias("agent"),
        F.lit(None).cast("string").alias("agent_name"),
        F.lit(None).cast("string").alias("assigned_agent"),
        F.lit("").alias("assignee"),
        text("1998-0", 1 + k % 8, "-01T00:00:00Z").alias("updated_at"),
        F.when(k % 7 == 0, F.array(_named(QUESTION.fields, status=F.lit("open"), question=F.lit("?")),
                                   _named(QUESTION.fields, assigned_agent=text("asker", k % 5)))).alias("active_questions"),
        F.when(k % 5 == 0, F.array(_named(TASK.fields, status=F.lit("resolved"), task_id=F.lit("t1")),
                                   _named(TASK.fields, status=F.lit("in_progress"), agent=text("worker", k % 4)),
                                   _named(TASK.fields, status=F.lit("Completed")))).alias("tasks"),
        F.struct(
            F.lit("b").alias("branch"), F.when(k % 13 == 0, text(".worktrees/issue-old-dir", k % 3)).alias("directory"),
            F.lit(None).cast("string").alias("path"),
        ).alias("worktree"),
        F.struct(F.when(k % 2 == 0, k).alias("number")).alias("github_issue"),
        F.when(k % 4 != 0, text("- [", box, "] a\n- [ ] b\n- [x] c")).alias("plan"),
    )


def _directories(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.when(k % 2 == 0, text("issue-", k, "-sup", F.col("s_nationkey"))).otherwise(text("issue-fix-", k, "-dev", F.col("s_nationkey"))).alias("directory")
    )


def _issues(spark, d):
    o = table(spark, d, "orders")
    latest = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("t"))
    return latest.select(F.col("o_custkey").alias("number"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"))


def _registry(spark, d):
    return G.registry(_customer_tracks(spark, d), _directories(spark, d), _issues(spark, d), F.lit(AS_OF))


def track_registry(spark, d):
    return longs(_registry(spark, d), *G.STATS)


def open_tracks(spark, d):
    listing = G.registry(_customer_tracks(spark, d), _directories(spark, d), _issues(spark, d), F.lit(AS_OF), open_only=True)
    return G.newest_first(listing).select("track_id", "status", "effective_time")


def track_totals(spark, d):
    return G.totals(_registry(spark, d))


_REG_SQL = """
    c AS (SELECT c_custkey AS k, 'fix_' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '_20260604' ELSE '' END AS track_id,
        ['COMPLETED', 'ACTIVE', 'PENDING', 'CLOSED', 'RESOLVED'][c_nationkey % 5 + 1] AS status, c_name AS description, c_mktsegment,
        CASE WHEN c_custkey % 2 = 0 THEN nullif(c_custkey, 0) END AS issue, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS issue_number FROM customer),
    dir AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS n, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey END AS slug,
        CASE WHEN s_suppkey % 2 = 0 THEN 'sup' ELSE 'dev' END || s_nationkey AS a FROM supplier),
    iss AS (SELECT o_custkey, max(o_orderdate) AS remote FROM orders GROUP BY 1),
    st AS (SELECT c.*, d1.a AS a1, d2.a AS a2, remote, make_timestamp(1998, 1 + (k % 8)::INT, 1, 0, 0, 0) AS loc,
        CASE WHEN k % 5 = 0 THEN 3 WHEN k % 4 <> 0 THEN 3 END AS total,
        CASE WHEN k % 5 = 0 THEN 1 WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN 2 ELSE 1 END AS completed,
        CASE WHEN k % 5 = 0 THEN 1 WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN 0 ELSE 1 END AS in_progress
      FROM c LEFT JOIN dir d1 ON d1.n = c.issue LEFT JOIN dir d2 ON d2.slug = c.k LEFT JOIN iss ON o_custkey = issue_number),
    reg AS (SELECT track_id, status, description,
        CASE WHEN k % 11 = 0 THEN c_mktsegment WHEN k % 7 = 0 THEN 'asker' || (k % 5) WHEN k % 5 = 0 THEN 'worker' || (k % 4)
             ELSE coalesce(a1, a2, CASE WHEN k % 13 = 0 THEN 'dir' || (k % 3) END) END AS agent,
        a1 IS NOT NULL OR a2 IS NOT NULL AS has_worktree, issue_number,
        total::BIGINT AS total, completed::BIGINT AS completed, in_progress::BIGINT AS in_progress,
        (total - completed - in_progress)::BIGINT AS pending,
        CASE WHEN remote >= loc THEN remote ELSE loc END AS effective_time, CASE WHEN remote >= loc THEN 'remote' ELSE 'local' END AS origin,
        coalesce((completed * 100) // total, 0)::INT AS percent FROM st),
    aged AS (SELECT *, epoch(TIMESTAMP '2003-09-01 12:00:00' - effective_time)::BIGINT AS s FROM reg)"""

def worktree_states(spark, d):
    trees = _directories(spark, d).select(F.replace("directory", F.lit("issue-fix-"), F.lit("fix_")).alias("directory"))
    out = G.worktree_status(trees, _customer_tracks(spark, d))
    return out.select("directory", "agent", "status", F.concat_ws("; ", "questions").alias("questions"), "has_metadata")


def inserted_tasks(spark, d):
    tasks = _tasks(spark, d).withColumn("task_id", text("ghi_", F.col("task_id") % 50))
    issues = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 1000).alias("track_id"), F.col("l_linenumber").cast("long").alias("number"),
        F.lit("title").alias("title"), F.lit("http://i").alias("url"),
    )
    return G.insert_tasks(tasks.withColumn("track_id", F.col("track_id").cast("long")), issues)


def latest_track(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), F.col("o_orderdate").alias("file_time"))
    return G.latest_track(o)


_BAR = "repeat('█', CASE {p} WHEN 0 THEN 0 WHEN 33 THEN 3 WHEN 66 THEN 7 WHEN 100 THEN 10 WHEN 50 THEN 5 END)"
_BAR_REST = "repeat('░', 10 - CASE {p} WHEN 0 THEN 0 WHEN 33 THEN 3 WHEN 66 THEN 7 WHEN 100 THEN 10 WHEN 50 THEN 5 END)"
_BARS = f"{_BAR} || {_BAR_REST}".replace("{p}", "percent")
_ANY_BAR = """repeat('█', CASE WHEN percent % 10 = 5 THEN CASE WHEN (percent // 10) % 2 = 0 THEN percent // 10 ELSE percent // 10 + 1 END
    ELSE (percent + 5) // 10 END::INT)"""
_ANY_BARS = f"{_ANY_BAR} || {_ANY_BAR.replace('█', '░').replace('repeat(', 'repeat(').replace('CASE WHEN percent % 10 = 5', '10 - CASE WHEN percent % 10 = 5', 1)}"

QUERIES = {
    "plan_progress": (
        plan_progress,
        f"""WITH b AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'x' WHEN 'P' THEN '~' ELSE ' ' END AS m1,
                ['x', 'X', '~', ' '][o_custkey % 4 + 1] AS m2 FROM orders),
        n AS (SELECT o_orderkey, (2 + (m2 <> 'X')::INT)::BIGINT AS total, (1 + (m1 = 'x')::INT + (m2 = 'x')::INT)::BIGINT AS completed,
                ((m1 = '~')::INT + (m2 = '~')::INT)::BIGINT AS in_progress, ((m1 = ' ')::INT + (m2 = ' ')::INT)::BIGINT AS pending FROM b),
        p AS (SELECT *, floor(completed / total * 100)::INT AS percent FROM n)
        SELECT *, {_BARS} AS bar, completed || '/' || total AS ratio FROM p""",
    ),
    "task_progress": (
        task_progress,
        f"""WITH n AS (SELECT o_custkey AS track_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed,
                count(*) FILTER (o_orderstatus = 'P') AS in_progress, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS pending
              FROM orders GROUP BY 1),
        p AS (SELECT *, floor(completed::DOUBLE / total::DOUBLE * 100)::INT AS percent FROM n)
        SELECT *, {_ANY_BARS} AS bar, completed || '/' || total AS ratio FROM p""",
    ),
    "effective_changes": (
        effective_changes,
        f"""WITH e AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate
                WHEN 1 THEN o_orderdate + INTERVAL '1 hour 4 minutes 5 seconds' WHEN 2 THEN o_orderdate
                ELSE o_orderdate - INTERVAL 5 MINUTE END AS changed,
                CASE WHEN o_orderkey % 4 < 2 THEN 'remote' ELSE 'local' END AS origin FROM orders),
        a AS (SELECT e.*, o_custkey * 37 % 100000 - 60 AS s FROM e JOIN orders USING (o_orderkey))
        SELECT o_orderkey, changed, origin, CASE WHEN s >= 86400 THEN (s // 86400) || 'days'
            WHEN s >= 3600 AND s % 3600 // 60 > 0 THEN (s // 3600) || 'h' || (s % 3600 // 60) || 'm' WHEN s >= 3600 THEN (s // 3600) || 'h'
            WHEN s < 0 THEN '59min'
            WHEN s >= 60 THEN (s // 60) || 'min' ELSE s || 'sec' END AS age FROM a""",
    ),
    "track_registry": (
        track_registry,
        f"""WITH {_REG_SQL} SELECT * EXCLUDE (s), {_BARS} AS bar,
            CASE WHEN total IS NULL THEN 'N/A' ELSE completed || '/' || total END AS ratio, (s // 86400) || 'days' AS age FROM aged""",
    ),
    "open_tracks": (
        open_tracks,
        f"WITH {_REG_SQL} SELECT track_id, status, effective_time FROM reg WHERE status NOT IN ('COMPLETED', 'CLOSED', 'RESOLVED')",
    ),
    "track_totals": (
        track_totals,
        f"""WITH {_REG_SQL} SELECT count(*) FILTER (status IN ('COMPLETED', 'CLOSED', 'RESOLVED')) AS n_completed,
            count(*) FILTER (status NOT IN ('COMPLETED', 'CLOSED', 'RESOLVED')) AS n_open, count(*) AS n_tracks,
            sum(completed) || '/' || sum(total) AS task_ratio, count(*) FILTER (has_worktree) AS n_worktrees FROM reg""",
    ),
    "worktree_states": (
        worktree_states,
        """WITH d AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'issue-' || s_suppkey || '-sup' || s_nationkey
                ELSE 'fix_' || s_suppkey || '-dev' || s_nationkey END AS directory,
                CASE WHEN s_suppkey % 2 = 1 AND s_suppkey % 3 <> 0 THEN s_suppkey END AS k FROM supplier)
        SELECT directory, CASE WHEN c_custkey IS NULL THEN NULL WHEN k % 11 = 0 THEN c_mktsegment ELSE 'Unknown' END AS agent,
            ['completed', 'active', 'pending', 'Closed', 'resolved'][c_nationkey % 5 + 1] AS status,
            CASE WHEN k % 7 = 0 THEN '[open] ?...; [unknown] ...' ELSE '' END AS questions, c_custkey IS NOT NULL AS has_metadata
        FROM d LEFT JOIN customer ON c_custkey = k""",
    ),
    "inserted_tasks": (
        inserted_tasks,
        """WITH t AS (SELECT o_custkey AS track_id, 'ghi_' || (o_orderkey % 50) AS task_id,
                CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'active' ELSE 'Open' END AS status FROM orders),
        n AS (SELECT DISTINCT l_orderkey % 1000 AS track_id, 'ghi_' || l_linenumber AS task_id FROM lineitem)
        SELECT track_id, task_id, status, NULL AS description, NULL AS github_issue_url FROM t
        UNION ALL SELECT track_id, task_id, 'pending', 'title', 'http://i' FROM n ANTI JOIN t USING (track_id, task_id)""",
    ),
    "latest_track": (latest_track, "SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS track_id FROM orders"),
}
