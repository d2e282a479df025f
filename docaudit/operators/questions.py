"""H1-H6: questions and answers in comment feeds.

Everything is an aggregate per (issue, agent) that Spark combines before it shuffles, so neither a long feed nor
a busy agent meets one task, and the same expressions serve batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import patterns as P
from docaudit.functions.text import strip

KEY = ["issue_number", "agent"]


def issues_awaiting(tracks: DataFrame) -> DataFrame:
    """H1: issues to poll: open tracks with a question awaiting a human and an issue number.

    Where tracks share an issue the last track id gives the title.
    """
    status = F.upper(F.coalesce("status", F.lit("unknown")))
    waiting = F.exists(
        F.coalesce("active_questions", F.array().cast(tracks.schema["active_questions"].dataType)),
        lambda q: F.equal_null(q["status"], F.lit("awaiting_human")),
    )
    number = F.col("github_issue.number")
    return (
        tracks.where(~status.isin(P.CLOSED_TRACKS) & waiting & (number != 0))
        .groupBy(number.alias("issue_number"))
        .agg(
            F.max("track_id").alias("track_id"),
            F.max_by(F.coalesce("description", F.lit("Awaiting input")), "track_id").alias("issue_title"),
        )
    )


def tagged(comments: DataFrame) -> DataFrame:
    """H2: comments that hold a question or an answer, with the agent meant and the text.

    A body with both tags is a question. Without an agent tag the author is meant.
    """
    body = F.col("body")
    is_question = F.rlike(body, F.lit(P.QUESTION_TAG))

    def part(group: int) -> Column:
        return F.when(is_question, F.regexp_extract(body, P.QUESTION_TAG, group)).otherwise(
            F.regexp_extract(body, P.ANSWER_TAG, group)
        )

    return comments.where(is_question | F.rlike(body, F.lit(P.ANSWER_TAG))).select(
        "issue_number",
        "seq",
        F.when(is_question, "question").otherwise("answer").alias("kind"),
        F.coalesce(F.nullif(part(1), F.lit("")), F.col("author")).alias("agent"),
        strip(part(2)).alias("text"),
        "author",
        "created_at",
    )


def snapshot_aggregates() -> list[Column]:
    """H3, H4 as aggregates: the latest question of an agent and the last answer to that agent.

    An answer that comes before the latest question belongs to an earlier one, so the last answer of all decides.
    """
    asked = F.when(F.col("kind") == "question", F.col("seq"))
    answered = F.when(F.col("kind") == "answer", F.col("seq"))
    return [
        F.max_by(F.struct("seq", "text", "created_at", "author"), asked).alias("q"),
        F.max_by(F.struct("seq", "text"), answered).alias("a"),
    ]


def shape_snapshot(latest: DataFrame) -> DataFrame:
    """H6: questions with their answer, answered or not."""
    return latest.where(F.col("q").isNotNull()).select(
        *KEY,
        F.col("q.text").alias("question"),
        F.col("q.created_at").alias("created_at"),
        F.col("q.author").alias("author"),
        F.when(F.col("a.seq") > F.col("q.seq"), F.col("a.text")).alias("answer"),
    )


def question_snapshot(comments: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """H3, H4, H6: each agent's latest question with the last answer after it.

    With ``issues`` (issue_number, issue_title) only their feeds are read and the title is added.
    """
    if issues is not None:
        comments = comments.join(issues.select("issue_number"), "issue_number", "left_semi")
    snapshot = shape_snapshot(tagged(comments).groupBy(*KEY).agg(*snapshot_aggregates()))
    if issues is not None:
        snapshot = snapshot.join(issues.select("issue_number", "issue_title"), "issue_number")
    return snapshot


def first_answers(comments: DataFrame) -> DataFrame:
    """H5: per (issue, agent) the first answer that follows some question of that agent."""
    tags = tagged(comments)
    asked = tags.where(F.col("kind") == "question").groupBy(*KEY).agg(F.min("seq").alias("first_question"))
    return (
        tags.where(F.col("kind") == "answer")
        .join(asked, KEY)
        .where(F.col("seq") > F.col("first_question"))
        .groupBy(*KEY)
        .agg(F.min_by("text", "seq").alias("answer"))
    )


#: Places of a feed that are ordered at once.
STRETCH = 1 << 16


def answer_history(comments: DataFrame, width: int = STRETCH) -> DataFrame:
    """H4 for all answers: each with the question it belongs to, the latest one of its agent before it; NULL where none was asked.

    An as-of join in stretches of ``width`` places: a stretch looks at its own questions in order and is told the last one before it, so
    no agent's feed is ordered in one task. Questions of a stretch are reduced before they are ordered by agent.
    """
    tags = tagged(comments).withColumn("stretch", F.floor(F.col("seq") / width))
    asked = F.when(F.col("kind") == "question", F.struct("seq", "text", "created_at"))
    tags = tags.withColumn("asked", asked)
    part = [*KEY, "stretch"]
    ends = tags.groupBy(*part).agg(F.max_by("asked", F.col("asked.seq")).alias("ends"))
    before = Window.partitionBy(*KEY).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*part, F.last("ends", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy(*part).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = tags.join(carried, part).withColumn("asked", F.coalesce(F.last("asked", ignorenulls=True).over(inside), F.col("carried")))
    return placed.where(F.col("kind") == "answer").select(
        *KEY,
        F.col("seq").alias("answer_seq"),
        F.col("text").alias("answer"),
        F.col("asked.seq").alias("question_seq"),
        F.col("asked.text").alias("question"),
        F.col("asked.created_at").alias("asked_at"),
    )


def answer_tracks(tracks: DataFrame, answers: DataFrame, as_of: Column) -> DataFrame:
    """H5: tracks of polled issues with their awaiting questions answered; ``updated_at`` is set where one was.

    The answers of the agents a track waits for are gathered as one map per track, no larger than its questions.
    """
    waiting = F.lit("awaiting_human")
    asked = tracks.select(
        "track_id", F.col("github_issue.number").alias("issue_number"), F.explode("active_questions").alias("question")
    ).where(F.col("question.status") == waiting)
    asked = asked.join(issues_awaiting(tracks).select("issue_number"), "issue_number", "left_semi")
    replies = (
        asked.select("track_id", "issue_number", F.col("question.agent").alias("agent"))
        .distinct()
        .join(answers, KEY)
        .groupBy("track_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("agent", "answer"))).alias("replies"))
    )

    def settled(q: Column) -> Column:
        reply = F.try_element_at(F.col("replies"), F.coalesce(q["agent"], F.lit("")))
        hit = (q["status"] == waiting) & reply.isNotNull()
        return F.when(
            hit, q.withField("status", F.lit("answered")).withField("answer", reply)
        ).otherwise(q)

    stamp = F.date_format(as_of.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        tracks.join(replies, "track_id", "left")
        .withColumn(
            "active_questions",
            F.when(F.col("replies").isNotNull(), F.transform("active_questions", settled)).otherwise(
                F.col("active_questions")
            ),
        )
        .withColumn("updated_at", F.when(F.col("replies").isNotNull(), stamp).otherwise(F.col("updated_at")))
        .drop("replies")
    )
