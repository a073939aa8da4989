"""Text to number and text to timestamp, failures to NULL (ANSI mode stays on)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date spellings that are recognised, tried in this order, and the shape
# each one has. "iso" stands for the ISO date or timestamp, with or without a time of day.
_SHAPES = {
    "iso": r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}
DATE_FORMATS = tuple(_SHAPES)
_ANY_SHAPE = r"^(\d{4}[-/]\d|\d{1,2}[-/ ][\dA-Za-z]|[A-Za-z]{3} \d|\d{8}$)"
# What a number looks like. Java would also read 1d, 2f and 0x1p3; data files do not mean that.
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))$"

# Every character that counts as white space, of any script.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(c: Column) -> Column:
    """Without leading and trailing white space of any script; only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_padded(c: Column) -> Column:
    return c != trimmed(c)


# A value is parsed only if it has the right shape: a failed parse costs an exception inside
# Spark, which for a column of ordinary words takes far longer than reading it.


def to_number(c: Column) -> Column:
    """Double value of a text, NULL where it is no number or reads NaN."""
    text = trimmed(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_time(c: Column, date_format: str) -> Column:
    """Wall-clock timestamp of a text in one format, else NULL."""
    text = trimmed(c)
    fits = text.rlike(_SHAPES[date_format])
    if date_format == "iso":
        return F.when(fits, text.try_cast("timestamp_ntz"))
    return F.when(fits, F.try_to_date(text, date_format)).cast("timestamp_ntz")


def to_time_any(c: Column) -> Column:
    """Wall-clock timestamp of a text in any recognised format, value by value."""
    text = trimmed(c)
    shaped = text.rlike(_ANY_SHAPE)
    return F.when(shaped, F.coalesce(*[to_time(c, f) for f in DATE_FORMATS]))


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session time zone."""
    return (
        F.unix_date(c.cast("date")) * F.lit(86_400_000_000)
        + F.hour(c) * F.lit(3_600_000_000)
        + F.minute(c).cast("bigint") * F.lit(60_000_000)
        + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    )


def from_micros(c: Column) -> Column:
    """Inverse of micros."""
    seconds = (c.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
