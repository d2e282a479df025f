"""Text expressions: sanitising, line handling, small formatters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions import patterns as P

_STRIP = rf"(?U)\A{P.SPACE}++|(?<!{P.SPACE}){P.SPACE}++\z"


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space (Spark's trim removes blanks only)."""
    return F.regexp_replace(c, _STRIP, "")


def _through_last_close(c: Column) -> Column:
    """The part of the text up to its last ``-->``; nothing after it can hold a closed comment.

    Searching this part only keeps a text full of unclosed openings from costing quadratic time.
    """
    tail = F.substring_index(c, "-->", -1)
    return F.left(c, F.length(c) - F.length(tail))


def count_comments(c: Column) -> Column:
    """Closed HTML comments in the text."""
    return F.when(F.contains(c, F.lit("<!--")), F.regexp_count(_through_last_close(c), F.lit(P.COMMENT))).otherwise(
        F.when(c.isNotNull(), F.lit(0))
    )


def strip_comments(c: Column) -> Column:
    """The text without closed HTML comments; unclosed ones stay."""
    return F.when(
        F.contains(c, F.lit("<!--")),
        F.concat(F.regexp_replace(_through_last_close(c), P.COMMENT, ""), F.substring_index(c, "-->", -1)),
    ).otherwise(c)


def count_invisible(c: Column) -> Column:
    """Runs of invisible characters."""
    return F.regexp_count(c, F.lit(P.INVISIBLE))


def strip_invisible(c: Column) -> Column:
    """The text without invisible characters."""
    return F.regexp_replace(c, P.INVISIBLE, "")


def split_lines(c: Column) -> Column:
    """The lines of a text, each with its line end."""
    return F.regexp_extract_all(c, F.lit(P.LINE), F.lit(0))


def count_injections(c: Column) -> Column:
    """T4: lines that open like an injected instruction."""
    return F.regexp_count(c, F.lit(P.INJECTION_LINE))


def drop_injections(c: Column) -> Column:
    """T4: the text without those lines, in one pass over the whole text."""
    return F.regexp_replace(c, P.INJECTION_LINE, "")


def withhold_secret(line: Column, keys: list[str] | None = None) -> Column:
    """Replace a ``KEY=value`` line by a notice when KEY is secret; a bare KEY is kept."""
    key = strip(F.substring_index(line, "=", 1))
    secret = F.contains(line, F.lit("=")) & key.isin(keys if keys is not None else P.SECRET_KEYS)
    return F.when(secret, F.concat(F.lit("# "), key, F.lit(" left out: secret value"))).otherwise(
        line
    )


def log_is_vacuous(output: Column) -> Column:
    """The log says that no test ran."""
    return F.rlike(output, F.lit(P.VACUOUS_LOG))


def log_verdict(exit_code: Column, output: Column) -> Column:
    """SKIP for a vacuous success, else PASS or FAIL by exit code."""
    return (
        F.when((exit_code == 0) & log_is_vacuous(output), "SKIP")
        .when(exit_code == 0, "PASS")
        .otherwise("FAIL")
    )


def preview(c: Column, length: int = 50) -> Column:
    """The first characters followed by dots."""
    return F.concat(F.left(F.coalesce(c, F.lit("")), F.lit(length)), F.lit("..."))


def first_heading(text: Column, default: str = "Unknown Product") -> Column:
    """First line of the stripped text that starts with ``# ``, without that mark."""
    line = F.regexp_extract(strip(text), r"(?:\A|\n)(# [^\n]*)", 1)
    return F.when(line == "", F.lit(default)).otherwise(F.replace(line, F.lit("# "), F.lit("")))


def suffix(path: Column) -> Column:
    """Lower-cased file name suffix without its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
