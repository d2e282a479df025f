"""The log of run events folded to agent and run state.

A log row is one command: ``init``, ``register`` or ``update``; ``seq`` orders the commands of a run and is
unique for a run and agent. State is derived on read. One run, or one agent, may own a third of the log, so no
step orders a whole run or agent in one task: where order matters the log is cut into stretches of ``WIDTH``
consecutive ``seq`` values, each stretch is reduced to one row, and only those rows are ordered. A stretch holds
at most ``WIDTH`` rows of an agent, and an agent at most ``(max(seq) - min(seq)) / WIDTH`` stretches: ``seq`` must be
about as dense as the events of a run, like a counter; for numbers made from clocks, pass a width of that many units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import patterns as P
from docaudit.functions.dates import micros
from docaudit.sources.shared import written

WIDTH = 1_000_000
# Events look up the inits of a shorter stretch, so that what each of them gets stays small.
LOOKUP = 1024
AGENT = ["run_id", "agent_id"]


def is_forced(events: DataFrame) -> Column:
    """Whether an init replaces a state that exists."""
    return F.coalesce(F.col("forced"), F.lit(False)) if "forced" in events.columns else F.lit(False)


def _filled(c: str) -> Column:
    """A text value, with empty text as NULL."""
    return F.nullif(F.col(c), F.lit(""))


# Validation ---------------------------------------------------------------------------------------------------


def run_starts(events: DataFrame) -> DataFrame:
    """where each run's present state begins: its first init or its last forced one, whichever is later."""
    inits = events.where(F.col("op") == "init").withColumn("_forced", is_forced(events))
    last_forced = F.when(F.col("_forced"), F.col("seq"))
    starts = inits.groupBy("run_id").agg(
        F.min("seq").alias("first_seq"), F.min_by("ts", "seq").alias("first_ts"), F.max(last_forced).alias("forced_seq"), F.max_by("ts", last_forced).alias("forced_ts")
    )
    again = F.col("forced_seq") > F.col("first_seq")
    return starts.select(
        "run_id",
        F.when(again, F.col("forced_seq")).otherwise(F.col("first_seq")).alias("start_seq"),
        F.when(again, F.col("forced_ts")).otherwise(F.col("first_ts")).alias("created_at"),
    )


def with_epochs(events: DataFrame, width: int = WIDTH) -> DataFrame:
    """adds ``epoch_seq``, the ``seq`` of the accepted init in force at each event (NULL before the first).

    Accepted inits are the first of a run and every forced one. One aggregate of the log gives each stretch of a run its inits, and its
    last one before; that table, a thousandth of the log, is written to the shared folder. Events look their stretch up, so no run is
    ordered as a whole.
    """
    width = min(width, LOOKUP)
    stretch = F.floor(F.col("seq") / width)
    init = F.when(F.col("op") == "init", F.col("seq"))
    forced = F.when(is_forced(events), init)
    stretches = events.groupBy("run_id", stretch.alias("stretch")).agg(
        F.min(init).alias("first"), F.collect_set(forced).alias("forced"), F.max(forced).alias("last_forced")
    )
    before = Window.partitionBy("run_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    first_before = F.min("first").over(before)
    # The first init of a run counts too, where no earlier stretch has one.
    own_first = F.when(first_before.isNull() & F.col("first").isNotNull(), F.array("first")).otherwise(F.array().cast("array<long>"))
    stretches = written(
        stretches.select(
            "run_id", "stretch", F.array_union("forced", own_first).alias("starts"), F.greatest(F.max("last_forced").over(before), first_before).alias("carried")
        ),
        "stretches",
    )
    here = F.array_max(F.filter("starts", lambda s: s <= F.col("seq")))
    return (
        events.withColumn("stretch", stretch)
        .join(stretches, ["run_id", "stretch"])
        .withColumn("epoch_seq", F.coalesce(here, F.col("carried")))
        .drop("stretch", "starts", "carried")
    )


def validate(events: DataFrame, width: int = WIDTH) -> DataFrame:
    """adds ``outcome``: accepted, ignored (repeated register) or rejected, and the ``reason``."""
    key = ["run_id", "epoch_seq", "agent_id"]
    placed = with_epochs(events, width)
    registers = (
        placed.where((F.col("op") == "register") & F.col("epoch_seq").isNotNull())
        .groupBy(*key)
        .agg(F.min("seq").alias("register_seq"))
    )
    joined = placed.join(registers, key, "left")
    op, seq, registered = F.col("op"), F.col("seq"), F.col("register_seq")
    reason = (
        F.when((op == "init") & (seq == F.col("epoch_seq")), F.lit(None))
        .when(op == "init", "state exists")
        .when(F.col("epoch_seq").isNull(), "no such run")
        .when((op == "register") & (seq > registered), "already registered")
        .when(op == "register", F.lit(None))
        .when(registered.isNull() | (seq < registered), "unknown agent")
        .when(~F.coalesce(F.col("status").isin(P.AGENT_STATUSES), F.lit(False)), "invalid status")
    )
    outcome = (
        F.when(F.col("reason").isNull(), "accepted")
        .when(F.col("reason") == "already registered", "ignored")
        .otherwise("rejected")
    )
    return joined.withColumn("reason", reason).withColumn("outcome", outcome)


def registrations(events: DataFrame, starts: DataFrame) -> DataFrame:
    """The first registration of every agent in the present state of its run."""
    return (
        events.where(F.col("op") == "register")
        .join(starts.select("run_id", "start_seq"), "run_id")
        .where(F.col("seq") > F.col("start_seq"))
        .groupBy(*AGENT)
        .agg(
            F.min("seq").alias("register_seq"),
            F.min_by("role", "seq").alias("role"),
            F.min_by("phase", "seq").alias("phase"),
        )
    )


def accepted_updates(events: DataFrame, registered: DataFrame) -> DataFrame:
    """Updates of registered agents with a valid status, after the registration."""
    return (
        events.where((F.col("op") == "update") & F.col("status").isin(P.AGENT_STATUSES))
        .join(registered.select(*AGENT, "register_seq"), AGENT)
        .where(F.col("seq") > F.col("register_seq"))
    )


def live_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registrations and accepted updates of the present state of every run.

    A registration lies after the start of the state, so updates need not be compared with that start again.
    """
    registered = registrations(events, run_starts(events))
    return registered, accepted_updates(events, registered)


# Fold ---------------------------------------------------------------------------------------------------------


def stretch_summaries(updates: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per agent and stretch of its updates; all that the fold needs from them."""
    part = [*AGENT, "stretch"]
    ordered = Window.partitionBy(*part).orderBy("seq")
    ended = F.col("status").isin(P.ENDED_STATUSES)
    why = F.when(F.col("status") == "interrupted", _filled("interrupt_reason"))
    marked = updates.withColumn("stretch", F.floor(F.col("seq") / width)).withColumn(
        "previous", F.lag("status").over(ordered)
    )
    entered = (F.col("status") == "running") & (F.col("previous") != "running")

    def last(value: Column, when: Column) -> Column:
        return F.max_by(F.when(when, value), F.when(when, F.col("seq")))

    return marked.groupBy(*part).agg(
        F.min("seq").alias("first_seq"),
        F.min_by("status", "seq").alias("first_status"),
        F.min_by("ts", "seq").alias("first_ts"),
        F.max_by("status", "seq").alias("last_status"),
        last(F.col("ts"), entered).alias("entered_at"),
        last(F.col("ts"), ended).alias("completed_at"),
        last(why, why.isNotNull()).alias("interrupt_reason"),
        last(_filled("output_path"), _filled("output_path").isNotNull()).alias("output_path"),
        F.count_if(F.col("status") == "failed").alias("retries"),
    )


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """One summary per agent from consecutive ones; a summary of summaries can be merged again."""
    before = F.lag("last_status").over(Window.partitionBy(*AGENT).orderBy("first_seq"))
    entered = F.when((F.col("first_status") == "running") & (F.col("before") != "running"), F.col("first_ts"))
    carried = summaries.withColumn("before", before).withColumn(
        "entered_at", F.coalesce(F.col("entered_at"), entered)
    )

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("first_seq"))).alias(c)

    return carried.groupBy(*AGENT).agg(
        F.min("first_seq").alias("first_seq"),
        F.min_by("first_status", "first_seq").alias("first_status"),
        F.min_by("first_ts", "first_seq").alias("first_ts"),
        F.max_by("last_status", "first_seq").alias("last_status"),
        last("entered_at"),
        last("completed_at"),
        last("interrupt_reason"),
        last("output_path"),
        F.sum("retries").alias("retries"),
    )


def state_of(registered: DataFrame, summaries: DataFrame) -> DataFrame:
    """state of every registered agent after its summarised updates; agents start out pending."""
    began = F.when(F.col("first_status") == "running", F.col("first_ts"))
    return registered.join(merge_summaries(summaries), AGENT, "left").select(
        *AGENT,
        "role",
        "phase",
        F.coalesce("last_status", F.lit("pending")).alias("status"),
        F.coalesce("retries", F.lit(0)).alias("retries"),
        "output_path",
        F.coalesce("entered_at", began).alias("started_at"),
        "completed_at",
        "interrupt_reason",
        "register_seq",
    )


def agent_state(events: DataFrame, width: int = WIDTH) -> DataFrame:
    """present state of every registered agent.

    ``started_at`` is the last change to running from another status, ``completed_at`` the last end, reasons and
    output paths the last non-empty ones given; ``retries`` counts updates to failed. None is ever cleared.
    """
    registered, updates = live_events(events)
    return state_of(registered, stretch_summaries(updates, width))


# Runs ---------------------------------------------------------------------------------------------------------


def hard_failure() -> Column:
    """Failed, or interrupted for another reason than quota; an unknown reason counts as another."""
    quota = F.equal_null(F.col("interrupt_reason"), F.lit(P.QUOTA))
    return (F.col("status") == "failed") | ((F.col("status") == "interrupted") & ~quota)


def run_status(runs: DataFrame, agents: DataFrame, strategy: Column | None = None) -> DataFrame:
    """status of every run with its agents counted by status.

    ``strategy`` is a column of ``runs``; only ``all_or_nothing`` has an effect.
    """
    counts = agents.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_agents"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in P.AGENT_STATUSES],
        F.count_if(hard_failure()).alias("n_hard"),
    )
    names = ["n_agents", *[f"n_{s}" for s in P.AGENT_STATUSES], "n_hard"]
    return (
        runs.withColumn("strategy", strategy if strategy is not None else F.lit(None).cast("string"))
        .join(counts, "run_id", "left")
        .na.fill(0, names)
        .withColumn("status", _status_of_counts())
    )


def _status_of_counts() -> Column:
    n, done, hard = F.col("n_agents"), F.col("n_completed"), F.col("n_hard")
    return (
        F.when(n == 0, "running")
        .when(F.equal_null(F.col("strategy"), F.lit("all_or_nothing")) & (hard > 0), "failed")
        .when(done == n, "completed")
        .when((done + hard == n) & (done > 0), "partial")
        .when(done + hard == n, "failed")
        .otherwise("running")
    )


def status_timeline(events: DataFrame, strategies: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """F4 after every event: for each registration and accepted update of the present state of a run, its agents by status and its status then.

    ``strategies`` holds (run_id, strategy). An event changes the counts of its run by what it makes of its agent, so two prefix scans over stretches
    give all states: along the agent, for the status and reason before the event, and along the run, for the sums of changes.
    A stretch is told what came before it, so neither an agent nor a run is ordered in one task.
    """
    registered, updates = live_events(events)
    why = F.when(F.col("status") == "interrupted", _filled("interrupt_reason"))
    new = registered.select(*AGENT, F.col("register_seq").alias("seq"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("why"))
    changes = new.unionByName(updates.select(*AGENT, "seq", "status", why.alias("why"))).withColumn("stretch", F.floor(F.col("seq") / width))

    part = [*AGENT, "stretch"]
    ends = changes.groupBy(*part).agg(F.max_by("status", "seq").alias("status"), F.max_by("why", F.when(F.col("why").isNotNull(), F.col("seq"))).alias("why"))
    earlier = Window.partitionBy(*AGENT).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*part, F.last("status").over(earlier).alias("was"), F.last("why", ignorenulls=True).over(earlier).alias("because"))
    along = Window.partitionBy(*part).orderBy("seq")
    before, upto = (along.rowsBetween(Window.unboundedPreceding, x) for x in (-1, 0))
    changes = changes.join(carried, part).withColumns(
        {
            "was": F.coalesce(F.lag("status").over(along), F.col("was")),
            "why_was": F.coalesce(F.last("why", ignorenulls=True).over(before), F.col("because")),
            "why_is": F.coalesce(F.last("why", ignorenulls=True).over(upto), F.col("because")),
        }
    )

    def hard(status: str, reason: str) -> Column:
        quota = F.equal_null(F.col(reason), F.lit(P.QUOTA))
        return F.coalesce((F.col(status) == "failed") | ((F.col(status) == "interrupted") & ~quota), F.lit(False)).cast("long")

    counts = {f"n_{s}": F.equal_null(F.col("status"), F.lit(s)).cast("long") - F.equal_null(F.col("was"), F.lit(s)).cast("long") for s in P.AGENT_STATUSES}
    counts = {"n_agents": F.col("was").isNull().cast("long")} | counts | {"n_hard": hard("status", "why_is") - hard("was", "why_was")}
    steps = changes.select("run_id", "stretch", "seq", "agent_id", *[v.alias(k) for k, v in counts.items()])

    sums = steps.groupBy("run_id", "stretch").agg(*[F.sum(k).alias(k) for k in counts])
    earlier = Window.partitionBy("run_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("run_id", "stretch", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in counts])
    upto = Window.partitionBy("run_id", "stretch").orderBy("seq", "agent_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.join(offsets, ["run_id", "stretch"]).withColumns({k: F.col(f"{k}_before") + F.sum(k).over(upto) for k in counts})
    if strategies is None:
        steps = steps.withColumn("strategy", F.lit(None).cast("string"))
    else:
        steps = steps.join(strategies.select("run_id", "strategy"), "run_id", "left")
    return steps.select("run_id", "seq", "agent_id", *counts, _status_of_counts().alias("status"))


def phase_listing(agents: DataFrame) -> DataFrame:
    """agents under their phase, phases in the order they were first seen."""
    first = agents.groupBy("run_id", "phase").agg(F.min("register_seq").alias("phase_seq"))
    return agents.join(first, ["run_id", "phase"]).orderBy("run_id", "phase_seq", "register_seq", "agent_id")


def with_limits(agents: DataFrame, runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """adds each run's retry limit and strategy from its profile; 2 retries when none is given.

    Profile names that hold a path separator or ``..`` match no profile.
    """
    name = F.col("profile")
    safe = F.when(~(F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")) | F.contains(name, F.lit(".."))), name)
    limits = profiles.select(
        F.col("name").alias("_profile"),
        F.coalesce("max_retry_attempts", "max_retries_per_agent").alias("_limit"),
        "strategy",
        "retry_failed",
    )
    named = runs.select("run_id", safe.alias("_profile"))
    return (
        agents.join(named.join(limits, "_profile", "left"), "run_id", "left")
        .withColumn("max_retries", F.coalesce("_limit", F.lit(2)))
        .drop("_profile", "_limit")
    )


def resumable(limited: DataFrame, honour_retry_failed: bool = False) -> DataFrame:
    """agents to dispatch again, with the reason: pending, stale running, interrupted, or failed with
    retries left. ``honour_retry_failed`` also drops failed agents whose profile says not to retry."""
    status = F.col("status")
    again = (status == "failed") & (F.col("retries") < F.col("max_retries"))
    if honour_retry_failed:
        again = again & F.coalesce("retry_failed", F.lit(True))
    why = (
        F.when(status == "failed", F.format_string("retry %d/%d", "retries", "max_retries"))
        .when(status == "running", "stale: was running at crash")
        .when(status == "interrupted", F.concat(F.lit("interrupted: "), F.coalesce("interrupt_reason", F.lit("None"))))
        .otherwise("")
    )
    return limited.where(status.isin("pending", "running", "interrupted") | again).withColumn("reason", why)


def run_age(runs: DataFrame, as_of: Column, stale_hours: float = 24.0) -> DataFrame:
    """F8: hours since each run was created, and whether that is over a day."""
    hours = (micros(as_of) - micros(F.col("created_at"))) / F.lit(3.6e9)
    return runs.withColumn("age_hours", hours).withColumn("stale", F.col("age_hours") > stale_hours)


def interrupt_all_running(
    events: DataFrame, agents: DataFrame, as_of: Column, reason: str = P.QUOTA
) -> DataFrame:
    """update events that interrupt every running agent; append them to the log.

    They form one step after the last of their run, so they share its ``seq``.
    """
    last = events.groupBy("run_id").agg((F.max("seq") + 1).alias("seq"))
    return (
        agents.where(F.col("status") == "running")
        .join(last, "run_id")
        .select(
            "run_id",
            "seq",
            as_of.cast("timestamp").alias("ts"),
            F.lit("update").alias("op"),
            "agent_id",
            "role",
            "phase",
            F.lit("interrupted").alias("status"),
            F.lit(None).cast("string").alias("output_path"),
            F.lit(reason).alias("interrupt_reason"),
        )
    )


# Declared rules -----------------------------------------------------------------------------------------------


def phase_readiness(agents: DataFrame, phases: DataFrame) -> DataFrame:
    """whether a phase may start: every earlier phase of the run has agents that all completed.

    ``phases`` lists (run_id, phase, ord); a run has few phases, its agents are counted before they are ordered.
    """
    done = agents.groupBy("run_id", "phase").agg(
        F.count(F.lit(1)).alias("n_agents"), F.count_if(F.col("status") == "completed").alias("n_completed")
    )
    earlier = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ok = (F.col("n_agents") > 0) & (F.col("n_completed") == F.col("n_agents"))
    return (
        phases.join(done, ["run_id", "phase"], "left")
        .na.fill(0, ["n_agents", "n_completed"])
        .withColumn("complete", ok)
        .withColumn("ready", F.coalesce(F.min("complete").over(earlier), F.lit(True)))
    )


def phase_retries(agents: DataFrame, cap: int = 6) -> DataFrame:
    """retries per run and phase, and whether they exceed the cap."""
    return agents.groupBy("run_id", "phase").agg(F.sum("retries").alias("retries")).withColumn(
        "exceeded", F.col("retries") > cap
    )


def expired_outputs(agents: DataFrame, as_of: Column, ttl_hours: Column) -> DataFrame:
    """outputs older than their time to live; without one an output never expires."""
    age = (micros(as_of) - micros(F.col("completed_at"))) / F.lit(3.6e9)
    return agents.where(F.col("output_path").isNotNull()).withColumn("age_hours", age).where(
        F.col("age_hours") > ttl_hours
    )


def first_over_limit(
    usage: DataFrame, limit: Column, keys: list[str], amount: str = "amount", width: int = WIDTH
) -> DataFrame:
    """for each key the first event whose running total passes the limit; a NULL limit is none.

    Totals of stretches are added up first; only the stretch in which a key crosses its limit is then ordered.
    ``seq`` is unique per key, so that stretch has at most ``width`` rows. Amounts are not negative.
    """
    placed = usage.withColumn("_limit", limit).withColumn("_stretch", F.floor(F.col("seq") / width))
    totals = placed.groupBy(*keys, "_stretch").agg(F.sum(amount).alias("_sum"), F.max("_limit").alias("_limit"))
    upto = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = (
        totals.withColumn("_upto", F.sum("_sum").over(upto))
        .withColumn("_before", F.col("_upto") - F.col("_sum"))
        .where((F.col("_before") <= F.col("_limit")) & (F.col("_upto") > F.col("_limit")))
        .select(*keys, "_stretch", "_before")
    )
    inside = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (
        placed.join(crossing, [*keys, "_stretch"])
        .withColumn("total", F.col("_before") + F.sum(amount).over(inside))
        .where(F.col("total") > F.col("_limit"))
    )
    return running.groupBy(*keys).agg(
        F.min("seq").alias("seq"), F.min_by("total", "seq").alias("total"), F.first("_limit").alias("limit")
    )
