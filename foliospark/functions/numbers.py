"""Rounding and printing of doubles by their exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.arrays import let

#: Twice the scale as powers of two, largest first.
_POWERS = {1: (16, 4), 2: (128, 64, 8)}


def half_even(value: Column, places: int) -> Column:
    """``value`` to one or two places, to the nearer one of its exact value; 0.25 to 0.2, 0.35 (a little less) to 0.3.

    Multiples by powers of two are exact, as is what is left of them beyond whole numbers, so the
    side of the midpoint on which a value lies is known exactly. Meant for values below 2^40.
    """
    scale, powers = 10**places, _POWERS[places]

    def rounded(x: Column) -> Column:
        floor = F.floor(x * F.lit(float(scale)))
        parts = [x * F.lit(float(p)) for p in powers]
        beyond = (2 * floor + 1 - sum((F.floor(p) for p in parts), F.lit(0))).cast("double")
        over = parts[0] - F.floor(parts[0]) - beyond
        for p in parts[1:]:
            over = over + (p - F.floor(p))
        up = (over > 0) | ((over == 0) & (F.pmod(floor, F.lit(2)) == 1))
        return (floor + up.cast("long")) / F.lit(float(scale))

    return F.signum(value) * let(F.abs(value.cast("double")), rounded)


def one_decimal(value: Column, signed: bool = False) -> Column:
    """Printed with one decimal, ties to even."""
    return F.format_string("%+.1f" if signed else "%.1f", half_even(value, 1))
