"""Date and time expressions. Nothing here reads the clock: ``as_of`` is always a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import patterns as P
from docaudit.functions.text import strip


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed a single time, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL when the parts name none; years start at 1.

    The parts are checked rather than parsed: a failed parse costs an exception per value.
    """
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when((year >= 1) & month.between(1, 12) & (day >= 1) & (day <= last), F.make_date(year, month, day))


#: Forms of dates: year first, year last, month in words.
YMD, MDY, WRITTEN = "ymd", "mdy", "written"


def date_pieces(raw: Column, form: Column) -> Column:
    """The pieces of a mention whose form is known, NULL if its separators differ."""
    mixed = F.contains(raw, F.lit("-")) & F.contains(raw, F.lit("/"))
    return F.when(form == WRITTEN, F.split(raw, rf"(?U),?{P.SPACE}+")).when(~mixed, F.split(raw, "[-/]"))


def _year_month_day(p: Column, form: Column) -> list[Column]:
    """Numbers of the pieces. Two-digit years pivot at 69. A missing year is 1900, so 29 February without a year is no date."""
    whole = lambda i: F.get(p, F.lit(i)).try_cast("int")
    months = F.create_map(*[F.lit(v) for i, m in enumerate(P.MONTHS, 1) for v in (m.lower(), i)])
    third, digits = whole(2), F.length(F.get(p, F.lit(2)))
    year = (
        F.when(form == YMD, whole(0))
        .when((form == WRITTEN) & (F.size(p) < 3), 1900)
        .when((form == WRITTEN) | (digits == 4), third)
        .when(digits == 2, F.pmod(third + 31, F.lit(100)) + 1969)
    )
    month = F.when(form == WRITTEN, F.try_element_at(months, F.lower(F.get(p, F.lit(0))))).otherwise(F.get(p, F.when(form == YMD, 1).otherwise(0)).try_cast("int"))
    return [year, month, F.get(p, F.when(form == YMD, 2).otherwise(1)).try_cast("int")]


def with_date(mentions: DataFrame, raw: str, form: str, name: str) -> DataFrame:
    """Adds the date of mentions whose form is known from the pattern that found them; each piece is made once per mention."""
    pieces = mentions.withColumn("_pieces", date_pieces(F.col(raw), F.col(form)))
    parts = pieces.withColumns(dict(zip(("_year", "_month", "_day"), _year_month_day(F.col("_pieces"), F.col(form)))))
    dated = parts.withColumn(name, calendar_date(F.col("_year"), F.col("_month"), F.col("_day")))
    return dated.drop("_pieces", "_year", "_month", "_day")


def claimed_date(raw: Column) -> Column:
    """The date of any text, NULL when it is no date. Numeric forms need equal separators."""
    form = (
        F.when(F.rlike(raw, F.lit(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$")), YMD)
        .when(F.rlike(raw, F.lit(r"^[0-9]{1,2}[-/][0-9]{1,2}[-/](?:[0-9]{4}|[0-9]{2})$")), MDY)
        .when(F.rlike(raw, F.lit(rf"(?U)^[A-Za-z]+{P.SPACE}+[0-9]{{1,2}}(?:,?{P.SPACE}+[0-9]{{4}})?$")), WRITTEN)
    )
    mention = F.struct(raw.alias("raw"), form.alias("form"))
    pieces = once(mention, lambda m: F.struct(date_pieces(m["raw"], m["form"]).alias("p"), m["form"].alias("form")))
    parts = once(pieces, lambda m: F.struct(*[c.alias(n) for n, c in zip("ymd", _year_month_day(m["p"], m["form"]))]))
    return once(parts, lambda n: calendar_date(n["y"], n["m"], n["d"]))


def normalise_date(raw: Column) -> Column:
    """``YYYY-MM-DD`` text of a date mention, NULL when it is no date."""
    return claimed_date(raw).cast("string")


def parse_timestamp(text: Column) -> Column:
    """Lenient timestamp in UTC: ISO with or without offset, else digits with zero fill, else NULL."""
    t = strip(text)
    iso = r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}(?:[^0-9][0-9:.,]+(?:Z|[+-][0-9:.]+)?)?$"
    spaced = F.regexp_replace(
        F.regexp_replace(t, r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})", "$1-$2-$3"), r"^(.{10}).", "$1T"
    )
    strict = F.when(F.rlike(t, F.lit(iso)), F.try_to_timestamp(spaced))
    parts = [F.regexp_extract(t, P.LOOSE_TIMESTAMP, i) for i in range(1, 7)]
    filled = [parts[0], parts[1], parts[2]] + [F.when(p == "", F.lit("00")).otherwise(p) for p in parts[3:]]
    date = F.concat_ws("-", *filled[:3])
    loose = F.when(
        parts[0] != "", F.try_to_timestamp(F.concat(date, F.lit(" "), F.concat_ws(":", *filled[3:])), F.lit("yyyy-MM-dd HH:mm:ss"))
    )
    return F.coalesce(strict, loose)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone."""
    return F.unix_micros(c.cast("timestamp"))


def age_seconds(then: Column, as_of: Column) -> Column:
    """Whole seconds from ``then`` to ``as_of``, cut towards zero."""
    age = micros(as_of) - micros(then)
    return F.when(age >= 0, F.floor(age / F.lit(1e6))).otherwise(F.ceil(age / F.lit(1e6)))


def relative_age(then: Column, as_of: Column) -> Column:
    """Short age text: ``1h1m``, ``1h``, ``5min``, ``59sec`` under a day, else ``3days``."""
    s = age_seconds(then, as_of)
    hours, minutes, seconds = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return (
        F.when(s >= 86400, F.format_string("%ddays", F.floor(s / 86400)))
        .when((hours > 0) & (minutes > 0), F.format_string("%dh%dm", hours, minutes))
        .when(hours > 0, F.format_string("%dh", hours))
        .when(minutes > 0, F.format_string("%dmin", minutes))
        .when(s.isNotNull(), F.format_string("%dsec", F.greatest(seconds, F.lit(0))))
    )
