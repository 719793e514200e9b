"""Rounding that agrees with IEEE half-even rounding of the exact binary value.

``F.round`` is half-up and ``F.bround`` rounds the shortest decimal text, so ``bround(0.35, 1)``
is 0.4 although the double lies below 0.35.  Scores cross rating thresholds, so the exact product
``x * 10**digits`` is formed as a rounded product plus its error term (Dekker's product).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float(2**27 + 1)


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Round a double to ``digits`` places, exact ties to the even neighbour."""
    x = x.cast("double")
    scale = float(10**digits)
    product = x * F.lit(scale)
    shifted = x * F.lit(_SPLIT)
    high = shifted - (shifted - x)
    error = (high * F.lit(scale) - product) + (x - high) * F.lit(scale)
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | (
        (rest == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2.0)) == 1)))
    )
    return (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)


def round_to_long(x: Column) -> Column:
    return round_half_even(x, 0).cast("long")
