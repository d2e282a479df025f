"""JSON records: claims, locale files, profiles, tracks, issue and comment feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit import schemas
from docaudit.functions import patterns as P
from docaudit.functions.dates import parse_timestamp
from docaudit.functions.text import suffix
from docaudit.sources.files import read_files


def parse_files(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Whole files parsed as one JSON object each; ``_bad`` holds the text of those that are none.

    Fields are read as text and cast one by one, so a value of another type is null and costs nothing else.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    no_object = F.try_parse_json(text).isNull() | F.json_object_keys(text).isNull()
    kept = T.StructType([f for f in schema if f.name != "_bad"])
    parsed = files.select(
        F.col("path").alias("file"),
        F.col("modified").alias("file_time"),
        F.when(no_object, text).alias("_bad"),
        F.when(~no_object, F.from_json(text, _as_text(kept), {"mode": "PERMISSIVE"})).alias("j"),
    )
    return parsed.select("file", "file_time", *[_typed(F.col("j")[f.name], f.dataType).alias(f.name) for f in kept], "_bad")


def _as_text(kind: T.DataType) -> T.DataType:
    """The same shape with text in all places that hold a single value."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _as_text(kind.valueType))
    return T.StringType()


def _typed(c: Column, kind: T.DataType) -> Column:
    """Text values cast to their types, null where they do not fit."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_typed(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _typed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _typed(x, kind.valueType))
    return c if isinstance(kind, T.StringType) else c.try_cast(kind)


def read_claims(spark: SparkSession, root: str) -> DataFrame:
    """Claims files as (path, claims); files that are no JSON object or have no ``claims`` array drop out."""
    return parse_claims(read_files(spark, root, "*.claims.json"))


def parse_claims(files: DataFrame) -> DataFrame:
    """Claims of files given as (path, content, modified)."""
    parsed = parse_files(files, schemas.CLAIMS_FILE)
    return parsed.where(F.col("_bad").isNull() & F.col("claims").isNotNull()).select(F.col("file").alias("path"), "claims")


def read_locales(spark: SparkSession, root: str) -> DataFrame:
    """JSON files below any folder named for locales, as (locale_file, json)."""
    inside = F.rlike(
        F.col("path"), F.lit(rf"(?i)(?:^|/)(?:{'|'.join(P.LOCALE_DIRECTORIES)})/")
    )
    files = read_files(spark, root, "*.[jJ][sS][oO][nN]").where(inside & (suffix(F.col("path")) == "json"))
    return files.select(
        F.col("path").alias("locale_file"), F.make_valid_utf8(F.col("content").cast("string")).alias("json")
    )


def read_profiles(spark: SparkSession, root: str) -> DataFrame:
    """Profile files with their name."""
    return parse_profiles(read_files(spark, root, "*.[jJ][sS][oO][nN]"))


def parse_profiles(files: DataFrame) -> DataFrame:
    """Profiles of files given as (path, content, modified)."""
    name = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    return parse_files(files, schemas.PROFILE).withColumn("name", name)


def deterministic_gates(profiles: DataFrame) -> DataFrame:
    """Gates that a program can check, in profile order.

    Any value of ``required`` counts as yes, except false, 0 and empty ones; JSON text is not told from other values here, so the text "false" is no, too.
    """
    no = F.col("gate.required").isin("false", "0", "0.0", "", "[]", "{}")
    gate = profiles.select("name", F.posexplode("quality_gates").alias("ord", "gate"))
    return gate.where(F.col("gate.mechanism") == "deterministic").select(
        "name",
        "ord",
        F.coalesce("gate.type", F.lit("unknown")).alias("gate_type"),
        # Changes outside the allowed folders block unless the profile says otherwise.
        F.coalesce(~no, F.col("gate.type").eqNullSafe("scope_validation")).alias("required"),
        F.col("gate.commit_scope").alias("commit_scope"),
    )


def profile_limits(profiles: DataFrame) -> DataFrame:
    """Retry limits and failure strategy per profile name, for the run log."""
    return profiles.select(
        "name",
        F.col("failure_strategy.max_retry_attempts").alias("max_retry_attempts"),
        F.col("budget.max_retries_per_agent").alias("max_retries_per_agent"),
        F.col("failure_strategy.strategy").alias("strategy"),
        F.col("failure_strategy.retry_failed").alias("retry_failed"),
    )


def read_tracks(spark: SparkSession, root: str) -> DataFrame:
    """One row per track folder: metadata, its error if it cannot be parsed, and the plan text."""
    return parse_tracks(read_files(spark, root, "{metadata.json,plan.md}"))


def parse_tracks(files: DataFrame) -> DataFrame:
    """Tracks of files given as (path, content, modified)."""
    track = F.regexp_extract("path", r"(?:^|/)([^/]+)/(?:metadata\.json|plan\.md)$", 1)
    meta = (
        parse_files(files.where(F.endswith(F.col("path"), F.lit("/metadata.json"))), schemas.TRACK_METADATA)
        .withColumn("track_id", F.regexp_extract("file", r"([^/]+)/metadata\.json$", 1))
        .withColumn("metadata_error", F.when(F.col("_bad").isNotNull(), F.lit("not a JSON object")))
        .drop("_bad", "file")
    )
    plans = files.where(F.endswith(F.col("path"), F.lit("/plan.md"))).select(
        track.alias("track_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("plan")
    )
    return meta.join(plans, "track_id", "full")


def read_comments(spark: SparkSession, root: str) -> DataFrame:
    """Comments of landed issue feeds, one JSON object per issue, numbered in feed order; objects that cannot be read drop out (see ``streaming.jobs.feed_sink``)."""
    feed = spark.read.schema(schemas.COMMENT_FEED).option("columnNameOfCorruptRecord", "_bad").json(root)
    return feed_comments(feed.where(F.col("_bad").isNull()))


def feed_comments(feed: DataFrame) -> DataFrame:
    """The comments of feeds (number, comments), numbered in feed order."""
    return feed.select(F.col("number").alias("issue_number"), F.posexplode("comments").alias("seq", "c")).select(
        "issue_number",
        F.col("seq").cast("long").alias("seq"),
        F.col("c.author.login").alias("author"),
        F.col("c.body").alias("body"),
        parse_timestamp(F.col("c.createdAt")).alias("created_at"),
    )


def read_issues(spark: SparkSession, root: str) -> DataFrame:
    """Issues as (number, title, url, updated_at text)."""
    raw = spark.read.schema("number long, title string, url string, updatedAt string").json(root)
    return raw.withColumnRenamed("updatedAt", "updated_at")
