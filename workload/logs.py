"""Run logs and question feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.operators import questions as Q
from docaudit.operators import runlog as R
from workload.common import longs, table, text

# Narrow stretches, so that the small tables exercise the cutting of long logs.
WIDTH = 1000


def run_events(spark, d):
    """User events as a run log: user = agent, ten runs, some sign-ups start a run (anew)."""
    e = table(spark, d, "events")
    kind, value, seq = F.col("event_type"), F.col("value"), F.col("event_id")
    starts = (kind == "signup") & (value > 60)
    op = F.when(starts, "init").when(kind == "signup", "register").otherwise("update")
    status = (
        F.when(kind == "view", "running").when(kind == "purchase", "completed").when(kind == "error", "failed")
        .when((kind == "click") & (seq % 9 == 0), "paused").when(kind == "click", "interrupted")
    )
    return e.select(
        (F.col("user_id") % 10).cast("string").alias("run_id"),
        seq.alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        op.alias("op"),
        F.when(op != "init", F.col("user_id").cast("string")).alias("agent_id"),
        text("role", F.col("user_id") % 3).alias("role"),
        text("phase", F.col("user_id") % 4).alias("phase"),
        F.when(op == "update", status).alias("status"),
        F.when(seq % 3 == 0, text("out/", seq)).otherwise("").alias("output_path"),
        F.when(seq % 4 == 0, "quota_exhausted").when(seq % 4 == 1, "manual").alias("interrupt_reason"),
        (starts & (seq % 5 == 0)).alias("forced"),
    )


def _runs(spark, d):
    profile = F.get(F.array(*map(F.lit, ["legal", "research", "../legal", "none"])), F.col("run_id").cast("int") % 4)
    return R.run_starts(run_events(spark, d)).withColumn("profile", profile)


def _profiles(spark, d):
    """A profile per region."""
    r = table(spark, d, "region")
    key = F.col("r_regionkey")
    return r.select(
        F.when(key == 0, "legal").when(key == 1, "research").otherwise(text("region", key)).alias("name"),
        F.when(key == 0, 3).cast("int").alias("max_retry_attempts"),
        F.lit(1).cast("int").alias("max_retries_per_agent"),
        F.when(key == 0, "all_or_nothing").otherwise("best_effort").alias("strategy"),
        (key == 0).alias("retry_failed"),
    )


_EVENTS_SQL = """
    ev AS (SELECT (user_id % 10)::VARCHAR AS run_id, event_id AS seq, ts, event_type, value,
            event_type = 'signup' AND value > 60 AS starts, user_id, user_id::VARCHAR AS agent_id FROM events),
    log AS (SELECT run_id, seq, ts, agent_id,
            CASE WHEN starts THEN 'init' WHEN event_type = 'signup' THEN 'register' ELSE 'update' END AS op,
            'role' || (user_id % 3) AS role, 'phase' || (user_id % 4) AS phase,
            CASE WHEN event_type = 'view' THEN 'running' WHEN event_type = 'purchase' THEN 'completed'
                 WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' AND seq % 9 = 0 THEN 'paused'
                 WHEN event_type = 'click' THEN 'interrupted' END AS status,
            CASE WHEN seq % 3 = 0 THEN 'out/' || seq END AS output_path,
            CASE seq % 4 WHEN 0 THEN 'quota_exhausted' WHEN 1 THEN 'manual' END AS why,
            starts AND seq % 5 = 0 AS forced FROM ev),
    ini AS (SELECT *, forced OR seq = min(seq) FILTER (op = 'init') OVER (PARTITION BY run_id) AS ok FROM log),
    ep AS (SELECT *, max(CASE WHEN op = 'init' AND ok THEN seq END)
            OVER (PARTITION BY run_id ORDER BY seq) AS epoch FROM ini),
    rg AS (SELECT *, min(CASE WHEN op = 'register' AND epoch IS NOT NULL THEN seq END)
            OVER (PARTITION BY run_id, epoch, agent_id) AS reg FROM ep),
    oc AS (SELECT *, CASE WHEN op = 'init' AND seq = epoch THEN NULL WHEN op = 'init' THEN 'state exists'
            WHEN epoch IS NULL THEN 'no such run'
            WHEN op = 'register' AND seq > reg THEN 'already registered' WHEN op = 'register' THEN NULL
            WHEN reg IS NULL OR seq < reg THEN 'unknown agent'
            WHEN status NOT IN ('pending', 'running', 'completed', 'failed', 'interrupted') THEN 'invalid status' END AS reason FROM rg),
    last_ep AS (SELECT run_id, max(epoch) AS epoch FROM ep GROUP BY run_id),
    live AS (SELECT o.* FROM oc o JOIN last_ep l ON o.run_id = l.run_id AND o.epoch = l.epoch WHERE o.reason IS NULL AND op <> 'init'),
    up AS (SELECT *, lag(status, 1, 'pending') OVER (PARTITION BY run_id, agent_id ORDER BY seq) AS prev FROM live WHERE op = 'update'),
    folded AS (SELECT run_id, agent_id, arg_max(status, seq) AS status, count(*) FILTER (status = 'failed') AS retries,
            max_by(output_path, seq) FILTER (output_path IS NOT NULL) AS output_path,
            max(ts) FILTER (status = 'running' AND prev <> 'running') AS started_at,
            max(ts) FILTER (status IN ('completed', 'failed', 'interrupted')) AS completed_at,
            arg_max(why, seq) FILTER (status = 'interrupted' AND why IS NOT NULL) AS interrupt_reason FROM up GROUP BY ALL),
    agent AS (SELECT r.run_id, r.agent_id, r.role, r.phase, coalesce(f.status, 'pending') AS status, coalesce(f.retries, 0) AS retries,
            f.output_path, f.started_at, f.completed_at, f.interrupt_reason, r.seq AS register_seq
        FROM live r LEFT JOIN folded f USING (run_id, agent_id) WHERE r.op = 'register'),
    hard AS (SELECT *, status = 'failed' OR (status = 'interrupted' AND interrupt_reason IS DISTINCT FROM 'quota_exhausted') AS is_hard FROM agent),
    run AS (SELECT l.run_id, l.epoch AS start_seq, (SELECT ts FROM log WHERE seq = l.epoch) AS created_at,
            ['legal', 'research', '../legal', 'none'][l.run_id::INT % 4 + 1] AS profile FROM last_ep l WHERE l.epoch IS NOT NULL)"""


def event_outcomes(spark, d):
    v = R.validate(run_events(spark, d), WIDTH)
    return v.select("run_id", "seq", "op", "epoch_seq", "outcome", "reason")


def agent_states(spark, d):
    return R.agent_state(run_events(spark, d), WIDTH)


def run_statuses(spark, d):
    runs = _runs(spark, d)
    status = R.run_status(
        runs.select("run_id", "profile"), agent_states(spark, d), F.when(F.col("profile") == "legal", "all_or_nothing")
    )
    return status.select("run_id", "profile", "n_agents", "n_pending", "n_running", "n_completed", "n_failed", "n_interrupted", "status")


def run_status_timeline(spark, d):
    strategies = _runs(spark, d).select("run_id", F.when(F.col("profile") == "legal", "all_or_nothing").alias("strategy"))
    return R.status_timeline(run_events(spark, d), strategies, WIDTH)


def phase_listing(spark, d):
    return R.phase_listing(agent_states(spark, d)).select("run_id", "phase", "phase_seq", "agent_id", "status", "retries")


def resumable_agents(spark, d):
    limited = R.with_limits(agent_states(spark, d), _runs(spark, d), _profiles(spark, d))
    return R.resumable(limited).select("run_id", "agent_id", "status", "retries", "max_retries", "reason")


def run_ages(spark, d):
    return R.run_age(_runs(spark, d), F.lit("2024-02-01 00:00:00")).select("run_id", "age_hours", "stale")


def interrupted_running(spark, d):
    events = run_events(spark, d)
    return R.interrupt_all_running(events, agent_states(spark, d), F.lit("2024-02-01 00:00:00")).select(
        "run_id", "seq", "ts", "op", "agent_id", "status", "interrupt_reason"
    )


def phase_readiness(spark, d):
    runs = R.run_starts(run_events(spark, d)).select("run_id")
    names = F.array(*[F.lit(f"phase{i}") for i in range(4)])
    phases = runs.select("run_id", F.posexplode(names).alias("ord", "phase"))
    ready = R.phase_readiness(agent_states(spark, d), phases)
    return ready.select("run_id", "phase", "n_agents", "n_completed", "complete", "ready")


def phase_retries(spark, d):
    return R.phase_retries(agent_states(spark, d), cap=6)


def expired_outputs(spark, d):
    limit = F.when(F.col("phase") != "phase3", F.lit(36.0))
    return R.expired_outputs(agent_states(spark, d), F.lit("2024-02-01 00:00:00"), limit).select("run_id", "agent_id", "output_path")


def spending_limits(spark, d):
    e = table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("seq"), F.floor(F.col("value")).alias("amount")
    )
    limit = F.when(F.col("user_id") % 7 != 0, (F.col("user_id") * 10).cast("long"))
    return longs(R.first_over_limit(e, limit, ["user_id"], width=WIDTH), "total", "limit")


# Questions ----------------------------------------------------------------------------------------------------


def comments(spark, d):
    """Chat turns as comments; two of three conversations name the agent in their tags."""
    c = table(spark, d, "conversations")
    agent = F.when(F.col("conv_id") % 3 != 0, text("[Ann", F.col("turn") % 2, "]")).otherwise("")
    body = (
        F.when(F.col("role") == "user", text("Hi\n[Question]", agent, "  ", F.col("text")))
        .when(F.col("role") == "assistant", text("[ANSWER]", agent, "\n", F.col("text")))
        .otherwise(F.col("text"))
    )
    return c.select(
        F.col("conv_id").alias("issue_number"), F.col("turn").alias("seq"), text("bot", F.col("conv_id") % 5).alias("author"),
        body.alias("body"), F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"),
    )


_TAGS_SQL = """
    tag AS (SELECT conv_id AS issue_number, turn AS seq, 'bot' || (conv_id % 5) AS author, role,
            CASE WHEN conv_id % 3 <> 0 THEN 'Ann' || (turn % 2) ELSE 'bot' || (conv_id % 5) END AS agent,
            trim(string_split(ltrim(text, chr(10) || chr(13) || chr(9) || ' '), chr(10))[1]) AS text,
            make_timestamp((conv_id * 1000 + turn) * 1000000) AS created_at
        FROM conversations WHERE role IN ('user', 'assistant')),
    q AS (SELECT issue_number, agent, max(seq) AS seq, arg_max(text, seq) AS question, arg_max(created_at, seq) AS created_at,
            arg_max(author, seq) AS author, min(seq) AS first_seq FROM tag WHERE role = 'user' GROUP BY 1, 2)"""


def question_snapshot(spark, d):
    return Q.question_snapshot(comments(spark, d))


def answer_history(spark, d):
    return Q.answer_history(comments(spark, d), width=3)


def first_answers(spark, d):
    return Q.first_answers(comments(spark, d))


def _tracks(spark, d):
    """One track per conversation, waiting for two agents."""
    heads = table(spark, d, "conversations").select("conv_id").distinct()
    k = F.col("conv_id")

    def question(agent, status):
        return F.struct(agent.alias("agent"), status.alias("status"), F.lit("?").alias("question"), F.lit(None).cast("string").alias("answer"))

    return heads.select(
        text("track", F.lpad(k.cast("string"), 9, "0")).alias("track_id"),
        F.when(k % 4 == 0, "completed").when(k % 4 == 1, "Closed").when(k % 4 == 2, "in_progress").alias("status"),
        F.when(k % 2 == 0, text("Talk ", k)).alias("description"),
        F.lit("2020-01-01T00:00:00Z").alias("updated_at"),
        F.struct((k - k % 2).alias("number")).alias("github_issue"),
        F.array(
            question(F.lit("Ann0"), F.when(k % 5 == 0, "answered").otherwise("awaiting_human")),
            question(text("bot", k % 5), F.when(k % 3 == 0, "awaiting_human").otherwise("open")),
        ).alias("active_questions"),
    )


def issues_awaiting(spark, d):
    return Q.issues_awaiting(_tracks(spark, d))


def polled_questions(spark, d):
    return Q.question_snapshot(comments(spark, d), issues_awaiting(spark, d)).select("issue_number", "issue_title", "agent", "question", "answer")


def answered_tracks(spark, d):
    done = Q.answer_tracks(_tracks(spark, d), Q.first_answers(comments(spark, d)), F.lit("2026-12-01 00:00:00"))
    return done.select(
        "track_id", "updated_at", F.concat_ws(",", F.transform("active_questions", lambda q: q["status"])).alias("statuses"),
        F.col("active_questions")[0]["answer"].alias("first_answer"), F.col("active_questions")[1]["answer"].alias("second_answer"),
    )


_TRACK_SQL = """
    tr AS (SELECT DISTINCT conv_id AS k, 'track' || lpad(conv_id::VARCHAR, 9, '0') AS track_id, conv_id - conv_id % 2 AS number,
        CASE WHEN conv_id % 5 = 0 THEN 'answered' ELSE 'awaiting_human' END AS s1,
        CASE WHEN conv_id % 3 = 0 THEN 'awaiting_human' ELSE 'open' END AS s2 FROM conversations)"""
_AWAIT_SQL = """
    wait AS (SELECT number AS issue_number, max(track_id) AS track_id,
            arg_max(CASE WHEN k % 2 = 0 THEN 'Talk ' || k ELSE 'Awaiting input' END, track_id) AS issue_title
        FROM tr WHERE k % 4 IN (2, 3) AND number <> 0 AND (s1 = 'awaiting_human' OR s2 = 'awaiting_human') GROUP BY number)"""
_ANSWER_SQL = """
    a AS (SELECT t.issue_number, t.agent, arg_max(t.text, t.seq) AS answer, max(t.seq) AS seq,
            arg_min(t.text, t.seq) FILTER (t.seq > q.first_seq) AS first_answer
        FROM tag t JOIN q USING (issue_number, agent) WHERE role = 'assistant' GROUP BY 1, 2)"""

QUERIES = {
    "event_outcomes": (
        event_outcomes,
        f"""WITH {_EVENTS_SQL} SELECT run_id, seq, op, epoch AS epoch_seq,
            CASE WHEN reason IS NULL THEN 'accepted' WHEN reason = 'already registered' THEN 'ignored' ELSE 'rejected' END AS outcome,
            reason FROM oc""",
    ),
    "agent_states": (agent_states, f"WITH {_EVENTS_SQL} SELECT * FROM agent"),
    "run_statuses": (
        run_statuses,
        f"""WITH {_EVENTS_SQL}, c AS (SELECT run.run_id, profile, count(agent_id) AS n_agents,
            count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'running') AS n_running,
            count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'failed') AS n_failed,
            count(*) FILTER (status = 'interrupted') AS n_interrupted, count(*) FILTER (is_hard) AS n_hard
            FROM run LEFT JOIN hard USING (run_id) GROUP BY 1, 2)
        SELECT * EXCLUDE (n_hard), CASE WHEN n_agents = 0 THEN 'running' WHEN profile = 'legal' AND n_hard > 0 THEN 'failed'
            WHEN n_completed = n_agents THEN 'completed' WHEN n_completed + n_hard = n_agents AND n_completed > 0 THEN 'partial'
            WHEN n_completed + n_hard = n_agents THEN 'failed' ELSE 'running' END AS status FROM c""",
    ),
    "run_status_timeline": (
        run_status_timeline,
        f"""WITH {_EVENTS_SQL}, step AS (SELECT l.run_id, l.agent_id, l.seq, CASE op WHEN 'register' THEN 'pending' ELSE l.status END AS status,
                CASE WHEN l.status = 'interrupted' AND op = 'update' THEN why END AS why FROM live l),
        told AS (SELECT *, last_value(why IGNORE NULLS) OVER (PARTITION BY run_id, agent_id ORDER BY seq) AS because FROM step),
        hd AS (SELECT *, (status = 'failed' OR (status = 'interrupted' AND because IS DISTINCT FROM 'quota_exhausted'))::INT AS hard FROM told),
        dl AS (SELECT *, lag(status) OVER w AS was, coalesce(lag(hard) OVER w, 0) AS was_hard FROM hd WINDOW w AS (PARTITION BY run_id, agent_id ORDER BY seq)),
        sm AS (SELECT run_id, seq, agent_id, count(*) FILTER (was IS NULL) OVER r AS n_agents,
            {", ".join(f"(count(*) FILTER (status = '{x}') OVER r - count(*) FILTER (was = '{x}') OVER r) AS n_{x}" for x in ("pending", "running", "completed", "failed", "interrupted"))},
            (sum(hard - was_hard) OVER r)::BIGINT AS n_hard FROM dl WINDOW r AS (PARTITION BY run_id ORDER BY seq))
        SELECT sm.*, CASE WHEN profile = 'legal' AND n_hard > 0 THEN 'failed' WHEN n_completed = n_agents THEN 'completed'
            WHEN n_completed + n_hard = n_agents AND n_completed > 0 THEN 'partial' WHEN n_completed + n_hard = n_agents THEN 'failed' ELSE 'running' END AS status
        FROM sm JOIN run USING (run_id)""",
    ),
    "phase_listing": (
        phase_listing,
        f"""WITH {_EVENTS_SQL} SELECT run_id, phase, min(register_seq) OVER (PARTITION BY run_id, phase) AS phase_seq, agent_id, status, retries
            FROM agent""",
    ),
    "resumable_agents": (
        resumable_agents,
        f"""WITH {_EVENTS_SQL}, l AS (SELECT agent.*, CASE profile WHEN 'legal' THEN 3 WHEN 'research' THEN 1 ELSE 2 END AS max_retries
            FROM agent JOIN run USING (run_id))
        SELECT run_id, agent_id, status, retries, max_retries::INT AS max_retries,
            CASE status WHEN 'failed' THEN 'retry ' || retries || '/' || max_retries WHEN 'running' THEN 'stale: was running at crash'
                WHEN 'interrupted' THEN 'interrupted: ' || coalesce(interrupt_reason, 'None') ELSE '' END AS reason
        FROM l WHERE status IN ('pending', 'running', 'interrupted') OR (status = 'failed' AND retries < max_retries)""",
    ),
    "run_ages": (
        run_ages,
        f"""WITH {_EVENTS_SQL} SELECT run_id, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 3.6e9 AS age_hours,
            (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 3.6e9 > 24 AS stale FROM run""",
    ),
    "interrupted_running": (
        interrupted_running,
        f"""WITH {_EVENTS_SQL}, l AS (SELECT run_id, max(seq) + 1 AS seq FROM log GROUP BY run_id)
        SELECT run_id, l.seq, TIMESTAMP '2024-02-01' AS ts, 'update' AS op, agent_id, 'interrupted' AS status,
               'quota_exhausted' AS interrupt_reason FROM agent JOIN l USING (run_id) WHERE status = 'running'""",
    ),
    "phase_readiness": (
        phase_readiness,
        f"""WITH {_EVENTS_SQL}, p AS (SELECT run_id, unnest(range(4)) AS ord FROM run),
        c AS (SELECT p.run_id, ord, 'phase' || ord AS phase, count(agent_id) AS n_agents, count(*) FILTER (status = 'completed') AS n_completed
              FROM p LEFT JOIN agent a ON a.run_id = p.run_id AND a.phase = 'phase' || ord GROUP BY 1, 2),
        k AS (SELECT *, n_agents > 0 AND n_agents = n_completed AS complete FROM c)
        SELECT run_id, phase, n_agents, n_completed, complete,
            coalesce(bool_and(complete) OVER (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ready
        FROM k""",
    ),
    "phase_retries": (
        phase_retries,
        f"WITH {_EVENTS_SQL} SELECT run_id, phase, sum(retries)::BIGINT AS retries, sum(retries) > 6 AS exceeded FROM agent GROUP BY 1, 2",
    ),
    "expired_outputs": (
        expired_outputs,
        f"""WITH {_EVENTS_SQL} SELECT run_id, agent_id, output_path FROM agent WHERE output_path IS NOT NULL AND phase <> 'phase3'
            AND (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(completed_at)) / 3.6e9 > 36""",
    ),
    "spending_limits": (
        spending_limits,
        """WITH r AS (SELECT user_id, event_id AS seq, user_id * 10 AS lim,
            sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM events WHERE user_id % 7 <> 0)
        SELECT user_id, min(seq) AS seq, arg_min(total, seq) AS total, any_value(lim)::BIGINT AS "limit" FROM r WHERE total > lim GROUP BY user_id""",
    ),
    "question_snapshot": (
        question_snapshot,
        f"""WITH {_TAGS_SQL}, {_ANSWER_SQL}
        SELECT q.issue_number, q.agent, question, created_at, author, CASE WHEN a.seq > q.seq THEN a.answer END AS answer
        FROM q LEFT JOIN a USING (issue_number, agent)""",
    ),
    "answer_history": (
        answer_history,
        f"""WITH {_TAGS_SQL}, asked AS (SELECT * FROM tag WHERE role = 'user')
        SELECT a.issue_number, a.agent, a.seq AS answer_seq, a.text AS answer, k.seq AS question_seq, k.text AS question, k.created_at AS asked_at
        FROM tag a ASOF LEFT JOIN asked k ON a.issue_number = k.issue_number AND a.agent = k.agent AND a.seq > k.seq WHERE a.role = 'assistant'""",
    ),
    "first_answers": (
        first_answers,
        f"WITH {_TAGS_SQL}, {_ANSWER_SQL} SELECT issue_number, agent, first_answer AS answer FROM a WHERE first_answer IS NOT NULL",
    ),
    "issues_awaiting": (issues_awaiting, f"WITH {_TRACK_SQL}, {_AWAIT_SQL} SELECT * FROM wait"),
    "polled_questions": (
        polled_questions,
        f"""WITH {_TAGS_SQL}, {_ANSWER_SQL}, {_TRACK_SQL}, {_AWAIT_SQL}
        SELECT q.issue_number, issue_title, q.agent, question, CASE WHEN a.seq > q.seq THEN a.answer END AS answer
        FROM q JOIN wait USING (issue_number) LEFT JOIN a USING (issue_number, agent)""",
    ),
    "answered_tracks": (
        answered_tracks,
        f"""WITH {_TAGS_SQL}, {_ANSWER_SQL}, {_TRACK_SQL}, {_AWAIT_SQL},
        j AS (SELECT track_id, s1, s2, CASE WHEN s1 = 'awaiting_human' THEN a1.first_answer END AS r1,
                CASE WHEN s2 = 'awaiting_human' THEN a2.first_answer END AS r2
              FROM tr LEFT JOIN (SELECT * FROM a WHERE issue_number IN (SELECT issue_number FROM wait)) a1 ON a1.issue_number = number AND a1.agent = 'Ann0'
                      LEFT JOIN (SELECT * FROM a WHERE issue_number IN (SELECT issue_number FROM wait)) a2 ON a2.issue_number = number AND a2.agent = 'bot' || (k % 5))
        SELECT track_id, CASE WHEN coalesce(r1, r2) IS NULL THEN '2020-01-01T00:00:00Z' ELSE '2026-12-01T00:00:00Z' END AS updated_at,
            CASE WHEN r1 IS NULL THEN s1 ELSE 'answered' END || ',' || CASE WHEN r2 IS NULL THEN s2 ELSE 'answered' END AS statuses,
            r1 AS first_answer, r2 AS second_answer FROM j""",
    ),
}
