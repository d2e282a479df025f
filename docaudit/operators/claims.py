"""Claims from prose and from claims files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import patterns as P
from docaudit.functions.dates import MDY, WRITTEN, YMD, with_date
from docaudit.functions.numbers import float_text, normalise_number, parse_float
from docaudit.functions.text import strip
from docaudit.schemas import CLAIM_COLUMNS


def mentions(line: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(group))


def entity_of(line: Column) -> Column:
    """The first capitalised phrase of the line that is not a common word; empty when there is none."""
    common = F.array(*map(F.lit, P.NOT_ENTITIES))
    return F.coalesce(F.get(F.array_except(mentions(line, P.ENTITY), common), F.lit(0)), F.lit(""))


def normalise_url(raw: Column) -> Column:
    """Lower-cased URL without trailing punctuation."""
    return F.lower(F.rtrim(raw, F.lit(P.CLAIM_URL_TAIL)))


def numbered_lines(docs: DataFrame, path: str = "path", text: str = "text", having: str | None = None) -> DataFrame:
    """Stripped lines of each document, numbered from 1; lines end at LF, CR or CRLF only. ``having``: only lines with this pattern."""
    lines = docs.select(F.col(path).alias("source_file"), F.posexplode(F.split(F.col(text), r"\r\n|[\r\n]")))
    if having:
        lines = lines.where(F.rlike(F.col("col"), F.lit(having)))
    return lines.select(
        "source_file", (F.col("pos") + 1).alias("line_number"), strip(F.col("col")).alias("raw_line")
    )


def text_claims(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Date, URL and number claims of each line, in one scan.

    Headings are treated like any line. Parts of dates count as numbers. A number needs an entity; a date
    without one stands for itself; a URL is its own entity and value. Mentions are found first, each with the kind that its
    pattern tells, and become rows; values are then plain columns, each made once.
    """
    line, raw, form = F.col("raw_line"), F.col("mention.raw"), F.col("mention.form")

    def found(pattern: str, name: str) -> Column:
        return F.transform(mentions(line, pattern), lambda m: F.struct(F.lit(name).alias("form"), m.alias("raw")))

    nothing = F.array().cast("array<struct<form:string,raw:string>>")
    patterns = list(zip(P.CLAIM_DATES, (YMD, MDY, WRITTEN)))
    dates = [F.when(guard, found(p, name)).otherwise(nothing) for (p, name), guard in zip(patterns, _guards(line))]
    links = F.when(F.rlike(line, F.lit("(?i)https?://")), found(P.CLAIM_URL, "url")).otherwise(nothing)
    numbers = F.when(F.col("phrase") != "", found(P.CLAIM_NUMBER, "numeric")).otherwise(nothing)
    rows = (
        numbered_lines(docs, path, text, r"(?iU)\d|https?://")
        .withColumn("phrase", F.lower(entity_of(line)))
        .select("*", F.posexplode(F.concat(*dates, links, numbers)).alias("pos", "mention"))
        .select("source_file", "line_number", "raw_line", "phrase", "pos", form.alias("form"), raw.alias("raw"))
    )
    dated = with_date(rows, "raw", "form", "_date")
    valued = dated.withColumn("_num", F.when(F.col("form") == "numeric", normalise_number(F.col("raw")))).withColumn(
        "_value",
        F.when(F.col("form") == "numeric", float_text(F.col("_num")))
        .when(F.col("form") == "url", normalise_url(F.col("raw")))
        .otherwise(F.col("_date").cast("string")),
    )
    kinds = F.when(F.col("form").isin("numeric", "url"), F.col("form")).otherwise("date")
    # The filter on values must not be moved below them, where it would make each a second time; rows of an array are a barrier to that.
    made = F.array(F.struct(kinds.alias("kind"), F.col("_value").alias("value"), F.col("_num").alias("num")))
    found_claims = valued.select("source_file", "line_number", "raw_line", "phrase", "pos", F.explode(made).alias("mention"))
    return _as_claims(found_claims)


def _guards(line: Column) -> list[Column]:
    """What a line must have for each form of date, by tests far cheaper than the patterns."""
    apart = F.rlike(line, F.lit(r"(?U)\d[-/]\d"))
    return [apart, apart, F.rlike(line, F.lit(rf"(?iU)(?:{'|'.join(m[:3] for m in P.MONTHS)})"))]


def _as_claims(found: DataFrame) -> DataFrame:
    line, none = F.col("raw_line"), F.lit(None).cast("double")
    kind, value = F.col("mention.kind"), F.col("mention.value")
    own_entity = (kind == "url") | ((kind == "date") & (F.col("phrase") == ""))
    return found.where(value.isNotNull()).select(
        F.lit(2).alias("layer"),
        "source_file",
        "line_number",
        "pos",
        kind.alias("claim_type"),
        F.when(own_entity, value).otherwise(F.col("phrase")).alias("entity"),
        value.alias("value"),
        F.col("mention.num").alias("value_num"),
        "raw_line",
        line.alias("context"),
        none.alias("confidence"),
        F.lit(None).cast("string").alias("source"),
    )


def structured_claims(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per entry of each claims file; ``files`` has a path and the ``claims`` array.

    A file without a ``claims`` array yields nothing.
    """
    entry = files.select(F.col(path).alias("source_file"), F.posexplode("claims").alias("pos", "entry"))
    entity = F.coalesce(F.col("entry.entity"), F.lit(""))
    attribute = F.coalesce(F.col("entry.attribute"), F.lit(""))
    value = F.coalesce(F.col("entry.value"), F.lit(""))
    confidence = F.coalesce(F.col("entry.confidence"), F.lit(1.0))
    source = F.coalesce(F.col("entry.source"), F.col("source_file"))
    named = F.concat(entity, F.lit("."), attribute)
    return entry.select(
        F.lit(1).alias("layer"),
        "source_file",
        F.lit(0).alias("line_number"),
        "pos",
        attribute.alias("claim_type"),
        F.lower(entity).alias("entity"),
        value.alias("value"),
        parse_float(value).alias("value_num"),
        F.concat(F.lit("[structured] "), named, F.lit("="), value).alias("raw_line"),
        F.concat(
            named, F.lit(" = "), value, F.lit(" (confidence="), float_text(confidence), F.lit(", source="), source,
            F.lit(")"),
        ).alias("context"),
        confidence.alias("confidence"),
        source.alias("source"),
    )


def all_claims(structured: DataFrame, text: DataFrame) -> DataFrame:
    """Both layers; structured claims displace text claims of the same entity and type."""
    covered = structured.select("entity", "claim_type").distinct()
    kept = text.join(covered, ["entity", "claim_type"], "left_anti")
    return structured.select(*CLAIM_COLUMNS).unionByName(kept.select(*CLAIM_COLUMNS))
