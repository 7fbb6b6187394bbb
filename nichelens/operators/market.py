"""Market statistics: what a niche looks like as of a date.

Inputs are plain tables: ``snapshots(channel_id, import_id, snapshot_date,
created_at, subscribers, err, predicted_views, cpv, campaign_price, ...)``,
``channels(channel_id, channel_name, channel_url, platform, niche_id)`` and
``niches(niche_id, slug, name)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelens.functions.stats import pick, quantiles, unpivot
from nichelens.vocab import COMPLETED_IMPORTS

METRICS = ("subscribers", "err", "predicted_views", "cpv", "campaign_price")
ALL_PLATFORMS = "ALL"


def _until(snapshots: DataFrame, as_of: str | None) -> DataFrame:
    return snapshots if as_of is None else snapshots.filter(F.col("snapshot_date") <= F.lit(as_of).cast("date"))


def latest_snapshot(snapshots: DataFrame, as_of: str | None = None) -> DataFrame:
    """Newest snapshot of every channel, optionally not after ``as_of``.

    Each task sorts its rows by channel and folds them, so a channel with a very
    long history moves one row per task. Ties on the date go to the latest
    created one.
    """
    payload = [c for c in snapshots.columns if c != "channel_id"]
    order = F.struct("snapshot_date", "created_at", "import_id")
    return (
        _until(snapshots, as_of)
        .groupBy("channel_id")
        .agg(F.max_by(F.struct(*payload), order).alias("s"))
        .select("channel_id", "s.*")
    )


def latest_snapshots_at(snapshots: DataFrame, dates: DataFrame) -> DataFrame:
    """Newest snapshot of every channel at each date of ``dates(as_of)``; one row a channel and date that has one.

    Every day is assigned to the first date not before it; snapshots fold to one
    a channel and such date, whatever the length of a history, and what holds at
    a date holds on until the next date with news. Only calendar days, never
    snapshots, are ordered in one place.
    """
    wanted = dates.select(F.col("as_of").cast("date").alias("at")).filter("at IS NOT NULL").distinct()
    days = snapshots.select(F.col("snapshot_date").alias("day")).distinct().withColumn("at", F.lit(None).cast("date"))
    days = days.unionByName(wanted.select(F.col("at").alias("day"), "at"))
    onward = Window.orderBy("day").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    slots = days.withColumn("slot", F.min("at").over(onward)).filter("at IS NULL AND slot IS NOT NULL").select("day", "slot")
    payload = [c for c in snapshots.columns if c != "channel_id"]
    order = F.struct("snapshot_date", "created_at", "import_id")
    news = (
        snapshots.join(slots, F.col("snapshot_date") == F.col("day"))
        .groupBy("channel_id", "slot")
        .agg(F.max_by(F.struct(*payload), order).alias("s"))
        .withColumn("until", F.lead("slot").over(Window.partitionBy("channel_id").orderBy("slot")))
    )
    every = wanted.agg(F.sort_array(F.collect_list("at"))).scalar()
    news = news.withColumn("every", every)
    holds = F.filter("every", lambda a: (a >= F.col("slot")) & (F.col("until").isNull() | (a < F.col("until"))))
    return news.select(F.explode(holds).alias("as_of"), "channel_id", "s.*")


def views_to_subscribers(views: Column, subscribers: Column) -> Column:
    """Reach per subscriber; unknown without subscribers or views."""
    return F.when(subscribers > 0, views.cast("double") / subscribers.cast("double"))


def scoped(df: DataFrame, platform: str | None = None, every_scope: bool = False) -> DataFrame:
    """Add ``scope``: one platform, all of them, or each and all in one pass."""
    if every_scope:
        return df.withColumn("scope", F.explode(F.array(F.lit(ALL_PLATFORMS), F.col("platform"))))
    if platform is None:
        return df.withColumn("scope", F.lit(ALL_PLATFORMS))
    return df.filter(F.col("platform") == platform).withColumn("scope", F.lit(platform))


def channel_state(
    snapshots: DataFrame,
    channels: DataFrame,
    as_of: str | None = None,
    platform: str | None = None,
    every_scope: bool = False,
) -> DataFrame:
    """Latest metrics of every channel that belongs to a niche, with its scope."""
    members = channels.filter(F.col("niche_id").isNotNull()).select(
        "channel_id", "platform", "niche_id"
    )
    current = latest_snapshot(
        snapshots.select("channel_id", "import_id", "snapshot_date", "created_at", *METRICS), as_of
    ).join(members, "channel_id")
    return scoped(current, platform, every_scope).withColumn(
        "views_to_subs",
        views_to_subscribers(F.col("predicted_views"), F.col("subscribers")),
    )


def niche_metrics(state: DataFrame) -> DataFrame:
    """Robust statistics per (scope, niche): counts, quartiles, medians."""
    keys = ["scope", "niche_id"]
    totals = state.groupBy(*keys).agg(
        F.count("*").alias("channels_count"),
        F.count("subscribers").alias("subscribers_known"),
        F.sum("subscribers").alias("total_subscribers"),
    )
    long = unpivot(state, keys, [*METRICS, "views_to_subs"])
    spread = (
        quantiles(long, [*keys, "metric"], (0.25, 0.5, 0.75))
        .groupBy(*keys)
        .agg(
            pick("subscribers", 1).alias("median_subscribers"),
            pick("subscribers", 0).alias("p25_subscribers"),
            pick("subscribers", 2).alias("p75_subscribers"),
            pick("err", 1).alias("median_err"),
            pick("predicted_views", 1).alias("median_views"),
            pick("cpv", 1).alias("median_cpv"),
            pick("campaign_price", 1).alias("median_campaign_price"),
            pick("views_to_subs", 1).alias("median_views_to_subs"),
        )
    )
    return totals.join(spread, keys, "left").withColumn("iqr_subscribers", iqr_subscribers())


def iqr_subscribers() -> Column:
    return F.col("p75_subscribers") - F.col("p25_subscribers")


def top_share(state: DataFrame, top_n: int = 3) -> DataFrame:
    """Share of a niche's subscribers held by its ``top_n`` channels.

    Only niches with more than ``top_n`` known channels: otherwise the top is
    the whole niche and the share says nothing. The row-number filter is cut to
    ``top_n`` rows per task before the shuffle; totals are a plain aggregate.
    """
    keys = ["scope", "niche_id"]
    known = state.filter(F.col("subscribers").isNotNull()).select(
        *keys, "channel_id", "subscribers"
    )
    position = Window.partitionBy(*keys).orderBy(F.desc("subscribers"), "channel_id")
    head = (
        known.withColumn("position", F.row_number().over(position))
        .filter(F.col("position") <= top_n)
        .groupBy(*keys)
        .agg(F.sum("subscribers").alias("head"))
    )
    totals = (
        known.groupBy(*keys)
        .agg(F.count("*").alias("known"), F.sum("subscribers").alias("total"))
        .filter(F.col("known") > top_n)
    )
    share = F.when(F.col("total") != 0, F.col("head").cast("double") / F.col("total"))
    return totals.join(head, keys).select(*keys, share.alias("top_channel_share"))


def channel_growth(snapshots: DataFrame, as_of: str | None = None) -> DataFrame:
    """Relative change from first to last snapshot of channels seen on two dates."""
    moment = F.struct("snapshot_date", "created_at")
    return (
        _until(snapshots, as_of)
        .filter(F.col("subscribers").isNotNull())
        .groupBy("channel_id")
        .agg(
            F.min("snapshot_date").alias("first_date"),
            F.max("snapshot_date").alias("last_date"),
            F.min_by("subscribers", moment).alias("first_subscribers"),
            F.max_by("subscribers", moment).alias("last_subscribers"),
        )
        .filter((F.col("first_date") < F.col("last_date")) & (F.col("first_subscribers") > 0))
        .withColumn(
            "growth_rate",
            (F.col("last_subscribers") - F.col("first_subscribers")).cast("double")
            / F.col("first_subscribers"),
        )
    )


def growth(
    snapshots: DataFrame,
    channels: DataFrame,
    as_of: str | None = None,
    platform: str | None = None,
    every_scope: bool = False,
) -> DataFrame:
    """Median growth and number of channels with history per (scope, niche)."""
    keys = ["scope", "niche_id"]
    members = channels.filter(F.col("niche_id").isNotNull()).select(
        "channel_id", "platform", "niche_id"
    )
    rates = scoped(
        channel_growth(snapshots, as_of).join(members, "channel_id"), platform, every_scope
    )
    medians = quantiles(unpivot(rates, keys, ["growth_rate"]).drop("metric"), keys, (0.5,))
    history = rates.groupBy(*keys).agg(F.count("*").alias("channels_with_history"))
    return history.join(medians, keys).select(
        *keys, F.col("q0").alias("median_growth_rate"), "channels_with_history"
    )


def assembled_metrics(
    snapshots: DataFrame,
    channels: DataFrame,
    niches: DataFrame,
    as_of: str | None = None,
    platform: str | None = None,
    every_scope: bool = False,
    top_n: int = 3,
) -> DataFrame:
    """One row per (scope, niche): metrics, concentration and growth together."""
    keys = ["scope", "niche_id"]
    state = channel_state(snapshots, channels, as_of, platform, every_scope)
    return (
        niche_metrics(state)
        .join(top_share(state, top_n), keys, "left")
        .join(growth(snapshots, channels, as_of, platform, every_scope), keys, "left")
        .join(niches.select("niche_id", "slug", "name"), "niche_id")
        .withColumn("channels_with_history", F.coalesce("channels_with_history", F.lit(0)))
    )


def dataset_summary(
    snapshots: DataFrame,
    channels: DataFrame,
    imports: DataFrame,
    platform: str | None = None,
) -> DataFrame:
    """One row describing the data. Imports ignore the platform; no date applies."""
    members = channels if platform is None else channels.filter(F.col("platform") == platform)
    seen = (
        snapshots
        if platform is None
        else snapshots.join(members.select("channel_id"), "channel_id", "left_semi")
    )
    by_channel = members.agg(
        F.count("*").alias("channels"),
        F.count_if(F.col("niche_id").isNull()).alias("channels_without_niche"),
        F.countDistinct("niche_id").alias("niches"),
    )
    by_snapshot = seen.agg(
        F.count("*").alias("snapshots"),
        F.countDistinct("snapshot_date").alias("snapshot_dates"),
        F.min("snapshot_date").alias("first_date"),
        F.max("snapshot_date").alias("last_date"),
    )
    done = imports.filter(F.col("status").isin(*COMPLETED_IMPORTS)).agg(
        F.count("*").alias("imports")
    )
    return one_row(by_channel, by_snapshot, done)


def one_row(*singles: DataFrame) -> DataFrame:
    """Single-row aggregates side by side: stacked, then folded into one row."""
    stacked, *rest = singles
    for other in rest:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for single in singles for c in single.columns])


def platform_counts(channels: DataFrame, platform: str | None = None) -> DataFrame:
    members = channels if platform is None else channels.filter(F.col("platform") == platform)
    return (
        members.groupBy("platform")
        .agg(F.count("*").alias("channels"))
        .orderBy(F.desc("channels"), "platform")
    )


def completed_sources(imports: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that have at least one completed import."""
    done = imports.filter(F.col("status").isin(*COMPLETED_IMPORTS)).select("source_id")
    return sources.join(done, "source_id", "left_semi").select("name", "kind").distinct().orderBy("name")


def market_overview(metrics: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All niches of a scope, largest first."""
    shown = columns or (
        "name", "channels_count", "median_subscribers", "p25_subscribers", "p75_subscribers",
        "median_err", "median_views", "median_views_to_subs", "median_cpv",
        "median_campaign_price", "top_channel_share",
    )
    return metrics.select("scope", *shown).orderBy("scope", F.desc("channels_count"), "name")
