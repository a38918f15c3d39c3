"""Half-even rounding on the scaled double, as array libraries do it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(value: Column | str, digits: int) -> Column:
    """``rint(x * 10^d) / 10^d``.

    ``bround`` works on the decimal text of a double and so differs on values
    such as 2.675, whose binary value lies below the tie.
    """
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)
