"""Scalar expressions: NULL policy, decimals, score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column) -> Column:
    """NaN and infinities become NULL; aggregates then skip them."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Apply ``finite`` to all (or the listed) floating-point columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    names = floats if columns is None else [c for c in columns if c in floats]
    return df.withColumns({n: finite(F.col(n)) for n in names}) if names else df


def rounded(c: Column, digits: int) -> Column:
    """``F.round`` of doubles to at most six digits.

    ``F.round`` writes every value as decimal text first, some 3 microseconds each.  Away from the boundary between
    two results, and where doubles are fine enough to tell, plain arithmetic gives the same.
    """
    if not 0 <= digits <= 6:
        raise ValueError(f"no plain arithmetic for {digits} digits")
    scale = 10.0**digits
    whole = F.rint(c * scale)
    clear = (F.abs(c) < 1e7) & (F.abs(c * scale - whole) < 0.49)
    return F.when(clear, whole / scale + F.lit(0.0)).otherwise(F.round(c, digits))


def ratio(a: Column, b: Column) -> Column:
    """Division where x/0 is NULL."""
    return F.try_divide(a, b)


def null_safe_false(condition: Column) -> Column:
    """A comparison with NULL counts as False."""
    return F.coalesce(condition, F.lit(False))


# Fixed value: digits kept by ``to_decimal``.
DECIMAL_DIGITS = 8


def _exact(c: Column) -> Column:
    # Through the text form, as 0.1 means the decimal 0.1 and not its binary neighbour.
    return c.cast("string").cast(T.DecimalType(38, 18))


def truncate_decimal(c: Column, digits: int = DECIMAL_DIGITS) -> Column:
    """Exact decimal with ``digits`` places, truncated toward zero."""
    d = _exact(c)
    return F.when(d >= 0, F.floor(d, F.lit(digits))).otherwise(F.ceil(d, F.lit(digits))).cast(T.DecimalType(38, digits))


def round_text(c: Column, digits: int) -> Column:
    """Half-up rounding to ``digits`` places, as text."""
    return F.round(_exact(c), digits).cast(T.DecimalType(38, digits)).cast("string")


def round_down_text(c: Column, digits: int) -> Column:
    """Truncation to ``digits`` places, as text."""
    return truncate_decimal(c, digits).cast("string")


def natural_log(c: Column) -> Column:
    """ln, NULL for values that are not positive."""
    return F.ln(F.when(c > 0, c))
