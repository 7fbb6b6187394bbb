"""Niche score: percentile-ranked components, renormalised weights, ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelens.functions.weighted import renormalized_mean

# Components, the metric or rating behind each, and direction.
DATA_COMPONENTS = (
    ("audience_value", "Audience value (CPV)", "median_cpv", False),
    ("ad_budget_level", "Ad budget level", "median_campaign_price", False),
    ("engagement", "Engagement (ERR)", "median_err", False),
    ("reach_efficiency", "Reach efficiency", "median_views_to_subs", False),
    ("market_size", "Market size", "channels_count", False),
    ("low_competition", "Low competition", "top_channel_share", True),
    ("growth_potential", "Growth potential", "median_growth_rate", False),
)
MANUAL_COMPONENTS = (
    ("content_scalability", "Content scalability", "content_scalability", False),
    ("low_production_cost", "Low production cost", "production_cost", True),
    ("originality_potential", "Originality potential", "originality_potential", False),
    ("brand_safety", "Brand safety", "brand_safety", False),
    ("low_monetization_risk", "Low monetization risk", "monetization_risk", True),
)
COMPONENT_ORDER = tuple(c[0] for c in DATA_COMPONENTS + MANUAL_COMPONENTS)
# Shipped weights, ratings and thresholds.
WEIGHTS = {
    "audience_value": 0.14,
    "ad_budget_level": 0.10,
    "engagement": 0.13,
    "reach_efficiency": 0.10,
    "market_size": 0.08,
    "low_competition": 0.13,
    "growth_potential": 0.07,
    "content_scalability": 0.09,
    "low_production_cost": 0.06,
    "originality_potential": 0.04,
    "brand_safety": 0.03,
    "low_monetization_risk": 0.03,
}
NEUTRAL_RATINGS = {
    "content_scalability": 50.0,
    "production_cost": 50.0,
    "originality_potential": 50.0,
    "brand_safety": 50.0,
    "monetization_risk": 50.0,
}
ASYMMETRY_GAP = 15.0


@dataclass(frozen=True)
class NicheScoreRules:
    """Weights and thresholds of one score version."""

    version: str = "niche_score_v1"
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    ratings: dict[str, float] = field(default_factory=lambda: dict(NEUTRAL_RATINGS))
    overrides: dict[str, dict[str, float]] = field(default_factory=dict)
    min_channels: int = 3
    top_n: int = 3
    low_confidence_below: int = 5


def percentile_rank(value: Column, groups: list[str]) -> Column:
    """``(below + 0.5 * equal) / n * 100`` among known values; NULL stays NULL.

    ``equal`` counts the value itself, so a single value lands on 50. This is
    neither ``percent_rank`` nor ``cume_dist``. Groups are the niches of one
    scope; all components share one shuffle.
    """
    population = Window.partitionBy(*groups)
    ordered = population.orderBy(value.asc_nulls_last())
    below = F.rank().over(ordered) - 1
    peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    equal = F.count(value).over(peers)
    known = F.count(value).over(population)
    return F.when(value.isNotNull(), (below + 0.5 * equal) / known * 100)


def is_eligible(rules: NicheScoreRules) -> Column:
    return F.col("channels_count") >= rules.min_channels


def split_eligible(metrics: DataFrame, rules: NicheScoreRules) -> tuple[DataFrame, DataFrame]:
    """(scorable, thin): thin niches neither get a score nor shape the scale."""
    return metrics.filter(is_eligible(rules)), metrics.filter(~is_eligible(rules))


def _part(key: str, source: str, rules: NicheScoreRules, value: Column, raw: Column, default: Column, note: Column) -> Column:
    labels = {k: label for k, label, _, _ in DATA_COMPONENTS + MANUAL_COMPONENTS}
    return F.struct(
        F.lit(key).alias("key"),
        F.lit(labels[key]).alias("label"),
        F.lit(source).alias("source"),
        F.lit(float(rules.weights.get(key, 0.0))).alias("weight"),
        value.alias("value"),
        raw.alias("raw_value"),
        value.isNotNull().alias("available"),
        default.alias("is_default_rating"),
        note.alias("note"),
    )


def _manual_part(key: str, rating: str, invert: bool, rules: NicheScoreRules) -> Column:
    chosen = F.lit(None).cast("double")
    for slug, ratings in rules.overrides.items():
        if rating in ratings:
            given = F.lit(float(ratings[rating]))
            chosen = F.when(F.col("slug") == slug, given).otherwise(chosen)
    raw = F.coalesce(chosen, F.lit(float(rules.ratings[rating])))
    note = F.when(chosen.isNull(), F.lit("neutral default, not a judgement yet"))
    value = 100 - raw if invert else raw
    return _part(key, "manual", rules, value, raw, chosen.isNull(), note)


def with_components(metrics: DataFrame, rules: NicheScoreRules) -> DataFrame:
    """Add ``parts``: the twelve components of every niche, NULL for thin niches.

    One pass over the niche table: thin niches are masked out of the ranked
    population instead of being split off and joined back.
    """
    masked = metrics
    for key, _, metric, _ in DATA_COMPONENTS:
        raw = F.when(is_eligible(rules), F.col(metric).cast("double"))
        masked = masked.withColumn(f"_raw_{key}", raw)
    ranks = {
        f"_rank_{key}": percentile_rank(F.col(f"_raw_{key}"), ["scope"])
        for key, _, _, _ in DATA_COMPONENTS
    }
    ranked = masked.withColumns(ranks)
    parts = []
    for key, _, _, invert in DATA_COMPONENTS:
        rank = F.col(f"_rank_{key}")
        value = 100 - rank if invert else rank
        note = F.when(value.isNull(), F.lit("no data in the current dataset"))
        parts.append(
            _part(key, "data", rules, value, F.col(f"_raw_{key}"), F.lit(False), note)
        )
    parts += [_manual_part(key, rating, inv, rules) for key, _, rating, inv in MANUAL_COMPONENTS]
    return ranked.select(*metrics.columns, F.when(is_eligible(rules), F.array(*parts)).alias("parts"))


def components(metrics: DataFrame, rules: NicheScoreRules, source: str | None = None) -> DataFrame:
    """Long form of the components of every scored niche."""
    rows = with_components(metrics, rules).select("scope", "niche_id", "slug", F.inline("parts"))
    return rows if source is None else rows.filter(F.col("source") == source)


def data_components(metrics: DataFrame, rules: NicheScoreRules) -> DataFrame:
    """The seven ranked metrics; only the concentration is inverted."""
    return components(metrics, rules, "data")


def manual_components(metrics: DataFrame, rules: NicheScoreRules) -> DataFrame:
    """Ratings set by hand per niche slug, else the neutral default, flagged as such."""
    return components(metrics, rules, "manual")


def score_niches(metrics: DataFrame, rules: NicheScoreRules | None = None) -> DataFrame:
    """Score, rank and breakdown of every niche of every scope in ``metrics``."""
    rules = rules or NicheScoreRules()
    fields = ["label", "source", "weight", "value", "raw_value", "available", "is_default_rating", "note"]
    breakdown = F.map_from_entries(
        F.transform(
            "parts", lambda p: F.struct(p["key"], F.struct(*[p[f].alias(f) for f in fields]))
        )
    )
    by_score = Window.partitionBy("scope").orderBy(
        F.col("score").desc_nulls_last(), F.col("name"), F.col("slug")
    )
    return (
        with_components(metrics, rules)
        .withColumn("score", renormalized_mean(F.col("parts")))
        .withColumn("components", breakdown)
        .drop("parts")
        .withColumn("insufficient_data", ~is_eligible(rules))
        .withColumn("position", F.row_number().over(by_score))
        .withColumn("rank", F.when(F.col("score").isNotNull(), F.col("position")))
        .drop("position")
        .withColumn("score_version", F.lit(rules.version))
    )


def component_value(key: str) -> Column:
    return F.col("components")[key]["value"]


def run_summary(scores: DataFrame, rules: NicheScoreRules | None = None) -> DataFrame:
    """Per scope: scored and skipped niches, and whether the ranking is coarse."""
    rules = rules or NicheScoreRules()
    return (
        scores.groupBy("scope")
        .agg(
            F.count("score").alias("niches_scored"),
            F.count_if(F.col("score").isNull()).alias("niches_skipped"),
        )
        .withColumn(
            "low_confidence",
            (F.col("niches_scored") > 0) & (F.col("niches_scored") < rules.low_confidence_below),
        )
    )


def persistable_run(
    scores: DataFrame, dataset: DataFrame, created_at: str, rules: NicheScoreRules | None = None
) -> tuple[DataFrame, DataFrame]:
    """(run rows, score rows) of one analysis, keyed by a deterministic run id."""
    rules = rules or NicheScoreRules()
    moment = F.lit(created_at).cast("timestamp")

    def run_id(scope: Column) -> Column:
        return F.sha2(F.concat_ws(":", F.lit(rules.version), scope, F.lit(created_at)), 256)

    platform = F.when(F.col("scope") != "ALL", F.col("scope"))
    facts = dataset.select(F.to_json(F.struct(*dataset.columns)).alias("dataset"))
    runs = run_summary(scores, rules).select(
        run_id(F.col("scope")).alias("run_id"),
        F.lit(rules.version).alias("score_version"),
        platform.alias("platform"),
        "niches_scored",
        "niches_skipped",
        "low_confidence",
        facts.scalar().alias("dataset"),
        moment.alias("created_at"),
    )
    rows = scores.select(
        run_id(F.col("scope")).alias("run_id"),
        "niche_id",
        "score_version",
        F.col("score").cast("decimal(5,2)").alias("score"),
        "rank",
        "channels_count",
        "insufficient_data",
        "components",
    )
    return runs, rows


def latest_run(
    runs: DataFrame,
    platform: str | None = None,
    any_scope: bool = False,
    score_version: str | None = None,
) -> DataFrame:
    """Newest run of exactly this scope; ``platform=None`` is the all-platforms run."""
    if not any_scope:
        runs = runs.filter(F.col("platform").eqNullSafe(F.lit(platform)))
    if score_version is not None:
        runs = runs.filter(F.col("score_version") == score_version)
    return runs.orderBy(F.desc("created_at"), "run_id").limit(1)


def scores_for_run(scores: DataFrame, niches: DataFrame, run: DataFrame) -> DataFrame:
    """Scores of the given run with niche names, ranked; unranked last."""
    return (
        scores.join(run.select("run_id"), "run_id", "left_semi")
        .join(niches.select("niche_id", "slug", "name"), "niche_id")
        .orderBy(F.col("rank").asc_nulls_last(), "name")
    )


def report_caveats(scores: DataFrame, rules: NicheScoreRules | None = None) -> DataFrame:
    """What a reader must know: ``(scope, caveat, detail, niches)`` rows.

    Every niche names the caveats it causes, so one pass and one aggregation do.
    """
    rules = rules or NicheScoreRules()
    scored = F.col("score").isNotNull()
    label = lambda caveat, detail: F.struct(
        F.lit(caveat).alias("caveat"), detail.alias("detail")
    )
    missing = F.map_keys(F.map_filter("components", lambda _, p: ~p["available"]))
    manual = F.map_values(F.map_filter("components", lambda _, p: p["source"] == "manual"))
    neutral = scored & F.forall(manual, lambda p: p["is_default_rating"])
    nothing = F.array().cast("array<struct<caveat: string, detail: string>>")
    caused = F.concat(
        F.coalesce(F.transform(missing, lambda k: label("unavailable_component", k)), nothing),
        F.array_compact(
            F.array(
                F.when(neutral, label("only_default_ratings", F.lit(""))),
                F.when(F.col("insufficient_data"), label("excluded_thin_niches", F.lit(""))),
                F.when(scored, label("low_confidence", F.lit(""))),
            )
        ),
    )
    counts = (
        scores.select("scope", F.inline(caused))
        .groupBy("scope", "caveat", "detail")
        .agg(F.count("*").alias("niches"))
    )
    return counts.filter(
        (F.col("caveat") != "low_confidence") | (F.col("niches") < rules.low_confidence_below)
    )


def ranking_table(scores: DataFrame, run_id: Column) -> DataFrame:
    """The 16 fixed columns and 12 component columns of the ranking report."""
    money = lambda c: F.format_string("%.2f", c)
    return scores.select(
        "rank",
        "slug",
        "name",
        F.when(F.col("score").isNotNull(), money(F.col("score"))).alias("score"),
        "score_version",
        run_id.alias("run_id"),
        "channels_count",
        "insufficient_data",
        "median_subscribers",
        "median_err",
        "median_views",
        "median_cpv",
        "median_campaign_price",
        "median_views_to_subs",
        "top_channel_share",
        "median_growth_rate",
        *[
            F.when(component_value(key).isNotNull(), money(component_value(key))).alias(key)
            for key in COMPONENT_ORDER
        ],
    ).orderBy(F.col("rank").asc_nulls_last(), "name")


def compare_platforms(
    scores: DataFrame, left: str = "TELEGRAM", right: str = "MAX"
) -> DataFrame:
    """Two rankings side by side, strongest weakest link first."""

    def side(scope: str, suffix: str) -> DataFrame:
        return scores.filter(F.col("scope") == scope).select(
            "slug",
            F.col("name").alias(f"name_{suffix}"),
            F.col("score").alias(f"score_{suffix}"),
            F.col("rank").alias(f"rank_{suffix}"),
            F.col("channels_count").alias(f"channels_{suffix}"),
        )

    a, b = F.col("score_telegram"), F.col("score_max")
    both = a.isNotNull() & b.isNotNull()
    gap = F.when(both, F.abs(a - b))
    # A weakest score of exactly 0 sorts like a missing one.
    weight = F.coalesce(F.nullif(F.col("weakest_score"), F.lit(0.0)), F.lit(-1.0))
    return (
        side(left, "telegram")
        .join(side(right, "max"), "slug", "full")
        .select(
            "slug",
            F.coalesce("name_telegram", "name_max").alias("name"),
            "score_telegram",
            "rank_telegram",
            F.coalesce("channels_telegram", F.lit(0)).alias("channels_telegram"),
            "score_max",
            "rank_max",
            F.coalesce("channels_max", F.lit(0)).alias("channels_max"),
            both.alias("on_both"),
            F.when(both, F.least(a, b)).alias("weakest_score"),
            gap.alias("gap"),
            F.coalesce(gap >= ASYMMETRY_GAP, F.lit(False)).alias("is_asymmetric"),
        )
        .orderBy(F.desc("on_both"), weight.desc(), "slug")
    )


__all__ = [
    "NicheScoreRules",
    "compare_platforms",
    "components",
    "data_components",
    "latest_run",
    "manual_components",
    "percentile_rank",
    "persistable_run",
    "ranking_table",
    "report_caveats",
    "run_summary",
    "score_niches",
    "scores_for_run",
]
