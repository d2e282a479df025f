"""Number expressions: parsing, text form, relative difference and its exact 1 % neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import patterns as P
from docaudit.functions.text import strip

# Above this relative difference two numbers conflict; smallest denominator.
TOLERANCE = 0.01
FLOOR = 1e-9


def parse_float(text: Column) -> Column:
    """The double a text stands for, NULL for anything else (no unit letters, no hexadecimal)."""
    t = strip(text)
    plain = F.regexp_replace(t, "_", "")
    unsigned_nan = F.regexp_replace(plain, r"(?i)^[+-](?=nan$)", "")
    return F.when(F.rlike(t, F.lit(P.FLOAT_TEXT)), unsigned_nan.try_cast("double"))


def normalise_number(raw: Column) -> Column:
    """C4: the number in a mention, without currency, grouping, percent sign and trailing unit."""
    bare = F.regexp_replace(F.regexp_replace(raw, P.NUMBER_DECORATION, ""), r"[A-Za-z]+\z", "")
    return bare.try_cast("double")


def float_text(x: Column) -> Column:
    """Shortest text of a double: plain between 1e-4 and 1e16, exponent form outside."""
    size = F.abs(x)
    java = x.cast("string")
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    exponent = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), r"E([0-9])", "E+$1"), r"E([+-])([0-9])$", "E$10$2"
    )
    return (
        F.when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-3) & (size < 1e7) | (size == 0), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.lower(exponent))
    )


def relative_difference(a: Column, b: Column) -> Column:
    """Distance over the larger size, NaN when either is infinite."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(FLOOR))


def exceeds_tolerance(a: Column, b: Column) -> Column:
    """HIGH test. NaN exceeds nothing (a plain comparison would say it does)."""
    rel = relative_difference(a, b)
    return ~F.isnan(rel) & (rel > TOLERANCE)


def with_lowest_neighbour(df: DataFrame, number: str, name: str) -> DataFrame:
    """Adds the least double within tolerance of a finite number from below; it never decreases with the number.

    An estimate is off by two units in the last place at most, so it and the doubles around it are put to the
    real test and the least that passes is taken. Steps are half units, since a logarithm may place a number
    just below a power of two one step too high.
    """
    a = F.col(number)
    guess = (
        F.when(a >= FLOOR, a * (1 - TOLERANCE))
        .when(a >= 0, a - TOLERANCE * FLOOR)
        .otherwise(F.least(a / (1 - TOLERANCE), a - TOLERANCE * FLOOR))
    )
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.abs(F.col("_guess")), F.lit(1e-290)))) - 53)
    tries = [F.col("_guess") + k * F.col("_step") for k in range(-5, 6)]
    passing = [F.when(~exceeds_tolerance(a, b), b) for b in tries]
    staged = df.withColumn("_guess", guess).withColumn("_step", step)
    return staged.select(*df.columns, F.least(a, *passing).alias(name))


def order_code(x: Column, bits: int = 28) -> Column:
    """A whole number that never decreases as finite ``x`` grows.

    Equal codes mean values within a factor of about 2**-bits of each other, so one code covers at most about
    2**(52 - bits) different doubles: a bound on the rows of a bucket that needs no look at the data.
    """
    scale = float(2**bits)
    size = F.floor(F.log(F.abs(x)) * scale).cast("long") + F.lit(746 * 2**bits)
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, size).otherwise(-size)


def whole_percent(done: Column, total: Column) -> Column:
    """Percentage cut to a whole number in double arithmetic; 0 when there is nothing to do."""
    ratio = done.cast("double") / F.nullif(total, F.lit(0)).cast("double")
    return F.coalesce(F.floor(ratio * 100).cast("int"), F.lit(0))


def progress_bar(percent: Column, width: int = 10) -> Column:
    """Bar of full and empty cells, halves rounded to even."""
    full = F.bround(percent / F.lit(100.0) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))
