"""Mergeable niche statistics: quantile sketches per import, stored and merged.

A KLL sketch of parameter ``k`` answers any quantile with a rank error that
does not depend on the number of values: about 2.3 / k^0.97 of all values, 1.3 %
for k = 200, at 99 % confidence. Sketches of imports merge into sketches of any
set of imports with the same bound, so that a new import is read once and old
ones never again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelens.functions.stats import unpivot
from nichelens.operators.market import METRICS

K = 200


def rank_error(k: int = K) -> float:
    """Part of all values by which the rank of an answer may be off."""
    return 2.296 / k**0.9723


def niche_sketches(snapshots: DataFrame, channels: DataFrame, metrics: Sequence[str] = METRICS, k: int = K) -> DataFrame:
    """``(import_id, niche_id, metric, n, sketch)`` of the known values of every import; channels without a niche stay out.

    Sketches are built where the values are and only sketches are shuffled.
    """
    members = channels.filter(F.col("niche_id").isNotNull()).select("channel_id", "niche_id")
    keys = ["import_id", "niche_id"]
    long = unpivot(snapshots.select("channel_id", "import_id", *metrics).join(members, "channel_id"), keys, metrics)
    return long.groupBy(*keys, "metric").agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")
    )


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Write the sketches of some imports; those of others stay as they are."""
    rows = sketches.hint("rebalance", "import_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("import_id").parquet(path)


def merged_quantiles(
    spark: SparkSession, path: str, probabilities: Sequence[float] = (0.25, 0.5, 0.75), imports: Sequence | None = None
) -> DataFrame:
    """``(niche_id, metric, n, quantiles array<double>)`` over the stored imports, or the given ones."""
    stored = spark.read.parquet(path)
    if imports is not None:
        stored = stored.filter(F.col("import_id").isin(list(imports)))
    both = stored.groupBy("niche_id", "metric").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    answers = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in probabilities])
    return both.select("niche_id", "metric", "n", answers.alias("quantiles"))
