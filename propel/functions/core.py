"""Column-expression helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000.0


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(c) -> Column:
    """As a session-zone timestamp (the views carry ``timestamp_ntz``)."""
    return col_(c).cast("timestamp")


def elapsed_days(later, earlier) -> Column:
    """R1: floor(elapsed time / 24 h), as pandas ``Timedelta.days``."""
    return F.floor((F.unix_micros(ts(later)) - F.unix_micros(ts(earlier))) / F.lit(DAY_MICROS)).cast("long")


def safe_div(num, den) -> Column:
    """Division that yields NULL on a zero or NULL denominator (pandas NaN)."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def guard_div(num, den) -> Column:
    """R6: num / max(den, 1)."""
    return col_(num).cast("double") / F.greatest(col_(den).cast("double"), F.lit(1.0))


def falsy(c) -> Column:
    """R4: Python truthiness of a stored value is False (None, 0, 0.0, False)."""
    c = col_(c)
    return c.isNull() | (c.cast("double") == 0)


def or_default(c, default) -> Column:
    """R4: ``x or d``."""
    return F.when(falsy(c), F.lit(default)).otherwise(col_(c))


def md5_mod(c, m: int = 100) -> Column:
    """int(md5(str(x)).hexdigest(), 16) % m, exactly, with 64-bit arithmetic.

    The 128-bit digest is split into four 32-bit words w0..w3 (big endian);
    value = sum(w_i * 2^(32*(3-i))). Reduce each power of 2^32 mod m first.
    """
    h = F.md5(col_(c).cast("string"))
    p = pow(2, 32, m)
    acc = F.lit(0).cast("long")
    for i in range(4):
        w = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") % m
        acc = (acc * p + w) % m
    return acc.cast("int")
