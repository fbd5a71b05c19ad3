"""Null-safe arithmetic. Unknown is NULL everywhere in the library, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """a / b, NULL when b is zero or either side is NULL."""
    return F.try_divide(as_col(a), as_col(b))


def nonzero(x) -> Column:
    """x with zero turned into NULL."""
    return F.when(as_col(x) != 0, as_col(x))


def number(x) -> Column:
    """Text to double; text that is no number, and NaN, become NULL."""
    return F.nullif(as_col(x).try_cast("double"), F.lit(float("nan")))


def whole(x) -> Column:
    """Text to long by truncation; text that is no number becomes 0."""
    return F.coalesce(number(x).try_cast("long"), F.lit(0).cast("long"))


def r(x, digits: int = 6) -> Column:
    """Round for comparison; the added zero turns -0.0 into 0.0."""
    return F.round(as_col(x).cast("double"), digits) + F.lit(0.0)


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.least(as_col(x), F.lit(high)), F.lit(low))


def f32(x) -> Column:
    """Cut to single precision for comparison. Binary rounding has no ties on the
    two-decimal amounts and their quotients, unlike rounding to decimal places."""
    return as_col(x).cast("float").cast("double") + F.lit(0.0)


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds of a time column. Times without a zone count as UTC, whatever the session's zone."""
    at = F.col(ts)
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        at = F.concat(at.cast("string"), F.lit("Z"))
    return F.unix_micros(at.cast("timestamp"))
