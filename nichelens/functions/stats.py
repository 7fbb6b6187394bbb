"""Exact order statistics that never gather a group in one task.

``percentile`` and ``cume_dist`` keep a whole group in one place, which fails
when one niche holds a third of all channels. Here equal values are folded
first, values fall into order-preserving bins (1024 per power of two), and only
per-bin totals are accumulated per group; the fine ordering happens inside one
bin at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_OCTAVE = 1024
_SHIFT = 1 << 21


def value_bin(v: Column) -> Column:
    """Weakly monotone bin number of a double."""
    magnitude = F.floor(F.log2(F.abs(v)) * BINS_PER_OCTAVE) + _SHIFT
    return F.when(v > 0, magnitude).when(v < 0, -magnitude).otherwise(F.lit(0).cast("bigint"))


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``(keys, metric, value double)`` without NULL values."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return (
        df.select(*keys, F.inline(pairs))
        .filter(F.col("value").isNotNull())
    )


def cumulative_counts(long: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group and distinct ``value``: ``below``, ``upto`` and group size ``n``.

    ``groups`` must not contain NULLs.
    """
    keys = [*groups, "bin"]
    counts = (
        long.groupBy(*groups, "value")
        .agg(F.count("*").alias("copies"))
        .withColumn("bin", value_bin(F.col("value")))
    )
    in_order = Window.partitionBy(*groups).orderBy("bin")
    bins = (
        counts.groupBy(*keys)
        .agg(F.sum("copies").alias("in_bin"))
        .withColumn("through_bin", F.sum("in_bin").over(in_order))
        .withColumn("n", F.sum("in_bin").over(Window.partitionBy(*groups)))
        .select(*keys, (F.col("through_bin") - F.col("in_bin")).alias("before_bin"), "n")
    )
    inside = Window.partitionBy(*keys).orderBy("value")
    return (
        counts.withColumn("through", F.sum("copies").over(inside))
        .join(bins, keys)
        .select(
            *groups,
            "value",
            (F.col("before_bin") + F.col("through") - F.col("copies")).alias("below"),
            (F.col("before_bin") + F.col("through")).alias("upto"),
            "n",
        )
    )


def quantiles(
    long: DataFrame, groups: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Interpolated quantiles (``percentile_cont``) as columns ``q0, q1, ...``."""
    positioned = cumulative_counts(long, groups)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("upto")), F.col("value")))

    ranks = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    picked = positioned.groupBy(*groups, "n").agg(
        *[at(F.floor(r)).alias(f"lo{i}") for i, r in enumerate(ranks)],
        *[at(F.ceil(r)).alias(f"hi{i}") for i, r in enumerate(ranks)],
    )
    return picked.select(
        *groups,
        *[
            (
                F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (r - F.floor(r))
            ).alias(f"q{i}")
            for i, r in enumerate(ranks)
        ],
    )


def pick(metric: str, quantile: int) -> Column:
    """Aggregate expression that pivots one metric's quantile out of the long form."""
    return F.max(F.when(F.col("metric") == metric, F.col(f"q{quantile}")))
