"""Rounding that does not depend on the order of a sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steady_round(col: Column | str, digits: int) -> Column:
    """Round half up after dropping floating-point noise.

    Partial sums meet in any order, so the last bits of a mean vary between
    runs; a first rounding at 12 digits keeps ties from flipping.
    """
    return F.round(F.round(col, 12), digits)


def significant(col: Column | str, digits: int = 9) -> Column:
    """Round to so many significant digits, whatever the size of the value.

    A nudge far below the last digit sends ties away from zero, also when noise left them short.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isNotNull(), F.format_string(f"%.{digits - 1}e", col.cast("double") * F.lit(1 + 1e-12)).cast("double"))
