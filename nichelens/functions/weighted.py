"""The renormalised weighted mean behind both scores, and its rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nichelens.functions.normalize import let


def round_percent(x: Column) -> Column:
    """Round a value in 0..100 to two places, half-even on its exact binary value.

    Spark's ``round`` and ``bround`` look at the shortest decimal form, so they
    turn 57.115 (stored slightly below) up. Splitting off the low bits keeps
    every step exact: ``hundredths`` and ``rest`` add up to ``100 * x``.
    """

    def split(v: Column) -> Column:
        high = F.floor(v * 1048576.0) / F.lit(1048576.0)
        whole = F.floor(high * 100.0).cast("double")
        rest = (high * 100.0 - whole) + (v - high) * 100.0
        carry = F.floor(rest).cast("double")
        return F.struct((whole + carry).alias("hundredths"), (rest - carry).alias("rest"))

    def chosen(p: Column) -> Column:
        odd = F.pmod(p["hundredths"], F.lit(2.0)) == 1.0
        up = (p["rest"] > 0.5) | ((p["rest"] == 0.5) & odd)
        return (p["hundredths"] + F.when(up, 1.0).otherwise(0.0)) / F.lit(100.0)

    return F.when(x.isNotNull(), let(let(x, split), chosen))


def renormalized_mean(components: Column) -> Column:
    """``sum(w*v)/sum(w)`` over components that have a value and a positive weight.

    ``components`` is ``array<struct<weight double, value double, ...>>``;
    missing components hand their weight to the others, none at all gives NULL.
    """
    usable = F.filter(components, lambda c: c["value"].isNotNull() & (c["weight"] > 0))
    zero = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"))
    mean = F.aggregate(
        usable,
        zero,
        lambda acc, c: F.struct(
            (acc["top"] + c["weight"] * c["value"]).alias("top"),
            (acc["bottom"] + c["weight"]).alias("bottom"),
        ),
        lambda acc: F.when(acc["bottom"] > 0, acc["top"] / acc["bottom"]),
    )
    return let(mean, round_percent)
