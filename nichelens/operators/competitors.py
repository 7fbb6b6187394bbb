"""Who leads a niche, what it takes to compete, and which channels are watched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelens.functions.stats import cumulative_counts, pick, quantiles, unpivot
from nichelens.operators.market import METRICS, latest_snapshot, scoped, views_to_subscribers

LEADER_METRICS = ("subscribers", "predicted_views", "err", "campaign_price", "cpv")
STANDING_METRICS = {"subscribers": "subscribers_pct", "err": "err_pct", "predicted_views": "views_pct"}
HEAD_SIZE = 10


def profiles(
    snapshots: DataFrame,
    channels: DataFrame,
    niches: DataFrame,
    niche_slug: str | None = None,
    platform: str | None = None,
) -> DataFrame:
    """Every channel with its latest metrics, without standing.

    ``niche_slug`` and ``platform`` are partition keys of every standing, so
    they cut the channels before the snapshots are touched.
    """
    named = niches.select(
        "niche_id", F.col("slug").alias("niche_slug"), F.col("name").alias("niche_name")
    )
    members = channels.select("channel_id", "channel_name", "channel_url", "platform", "niche_id")
    if platform is not None:
        members = members.filter(F.col("platform") == platform)
    if niche_slug is not None:
        members = members.join(named.filter(F.col("niche_slug") == niche_slug), "niche_id")
    else:
        members = members.join(named, "niche_id", "left")
    current = latest_snapshot(
        snapshots.select(
            "channel_id", "import_id", "snapshot_date", "created_at", "currency", *METRICS
        )
    )
    return (
        current.join(members, "channel_id")
        .withColumn(
            "views_to_subs",
            views_to_subscribers(F.col("predicted_views"), F.col("subscribers")),
        )
    )


def enriched(base: DataFrame) -> DataFrame:
    """``profiles`` plus percentile standing within the channel's niche and platform.

    Standing is ``cume_dist * 100`` with NULLs last: an unknown value stands at
    100. Counting through folded values keeps a dominant niche off one task.
    """
    peers = ["_peers", "platform"]
    # Channels without a niche are peers of each other.
    keyed = base.withColumn(
        "_peers", F.coalesce(F.concat(F.lit("n"), F.col("niche_id").cast("string")), F.lit("-"))
    )
    known = unpivot(keyed, [*peers, "channel_id"], list(STANDING_METRICS))
    reached = cumulative_counts(known.drop("channel_id"), [*peers, "metric"])
    sizes = keyed.groupBy(*peers).agg(F.count("*").alias("_size"))
    standing = (
        known.join(reached.select(*peers, "metric", "value", "upto"), [*peers, "metric", "value"])
        .groupBy("channel_id")
        .agg(
            *[
                F.max(F.when(F.col("metric") == m, F.col("upto"))).alias(f"_{name}")
                for m, name in STANDING_METRICS.items()
            ]
        )
    )
    pct = [
        (F.coalesce(f"_{name}", "_size") / F.col("_size") * 100).alias(name)
        for name in STANDING_METRICS.values()
    ]
    return (
        keyed.join(standing, "channel_id", "left")
        .join(sizes, peers)
        .select(*base.columns, *pct)
    )


def niche_benchmarks(
    base: DataFrame, head_size: int = HEAD_SIZE, every_scope: bool = False
) -> DataFrame:
    """Distribution of each niche: quantiles, extremes and head share.

    Niches without channels do not appear.
    """
    keys = ["scope", "niche_slug"]
    rows = scoped(base.filter(F.col("niche_slug").isNotNull()), every_scope=every_scope)
    totals = rows.groupBy(*keys).agg(
        F.first("niche_name").alias("niche_name"),
        F.count("*").alias("channels_count"),
        F.max("subscribers").alias("subscribers_max"),
        F.sum("subscribers").alias("subscribers_total"),
        F.max("snapshot_date").alias("snapshot_date"),
    )
    spread = (
        quantiles(
            unpivot(rows, keys, METRICS), [*keys, "metric"], (0.10, 0.25, 0.50, 0.75, 0.90)
        )
        .groupBy(*keys)
        .agg(
            pick("subscribers", 0).alias("subscribers_p10"),
            pick("subscribers", 1).alias("subscribers_p25"),
            pick("subscribers", 2).alias("subscribers_p50"),
            pick("subscribers", 3).alias("subscribers_p75"),
            pick("subscribers", 4).alias("subscribers_p90"),
            pick("err", 1).alias("err_p25"),
            pick("err", 2).alias("err_p50"),
            pick("err", 3).alias("err_p75"),
            pick("predicted_views", 2).alias("views_p50"),
            pick("predicted_views", 4).alias("views_p90"),
            pick("cpv", 2).alias("cpv_p50"),
            pick("campaign_price", 2).alias("price_p50"),
        )
    )
    return (
        totals.join(spread, keys, "left")
        .join(head_share(rows, head_size), keys, "left")
        .withColumn("head_size", F.lit(head_size))
    )


def head_share(rows: DataFrame, head_size: int = HEAD_SIZE) -> DataFrame:
    """Share of subscribers in the ``head_size`` largest channels, small niches included."""
    keys = ["scope", "niche_slug"]
    known = rows.filter(F.col("subscribers").isNotNull()).select(
        *keys, "channel_id", "subscribers"
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("subscribers"), "channel_id")
    head = (
        known.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= head_size)
        .groupBy(*keys)
        .agg(F.sum("subscribers").alias("head"))
    )
    totals = known.groupBy(*keys).agg(
        F.count("*").alias("ranked_channels"), F.sum("subscribers").alias("total")
    )
    share = F.when(F.col("total") != 0, F.col("head").cast("double") / F.col("total"))
    return totals.join(head, keys).select(*keys, share.alias("head_share"), "ranked_channels")


def leaders(
    rows: DataFrame,
    metric: str = "subscribers",
    limit: int = 10,
    min_subscribers: Column | int | None = None,
    keys: tuple[str, ...] = ("niche_slug",),
) -> DataFrame:
    """Top ``limit`` channels of each niche by one metric, with ``position``.

    A subscriber floor keeps tiny channels, whose rates are an artefact of the
    denominator, off the board. The top-k cut happens before the shuffle.
    """
    if metric not in LEADER_METRICS:
        raise ValueError(f"unknown leader metric {metric!r}")
    rows = rows.filter(F.col(metric).isNotNull())
    if min_subscribers is not None:
        floor = min_subscribers if isinstance(min_subscribers, Column) else F.lit(min_subscribers)
        rows = rows.filter(F.col("subscribers") >= floor)
    order = Window.partitionBy(*keys).orderBy(F.desc(metric), "channel_id")
    return rows.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= limit
    )


def channel_profile(standing: DataFrame, channel_id: object) -> DataFrame:
    """One channel with its standing."""
    return standing.filter(F.col("channel_id") == F.lit(channel_id))


def search_channels(standing: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Case-insensitive search in name and URL; ``%`` and ``_`` act as wildcards."""
    pattern = f"%{query}%"
    return (
        standing.filter(
            F.col("channel_name").ilike(pattern) | F.col("channel_url").ilike(pattern)
        )
        .orderBy(F.col("subscribers").desc_nulls_last(), "channel_id")
        .limit(limit)
    )


def watchlist(standing: DataFrame, watched: DataFrame) -> DataFrame:
    """Watched channels with their standing and notes."""
    notes = watched.select(
        "channel_id", F.col("notes").alias("watch_notes"), F.col("created_at").alias("watched_at")
    )
    return standing.join(notes, "channel_id").orderBy(
        F.col("niche_name").asc_nulls_last(),
        F.col("subscribers").desc_nulls_last(),
        "channel_id",
    )


def watch(watched: DataFrame, requests: DataFrame, channels: DataFrame) -> DataFrame:
    """New version of the watchlist after upserting ``requests(channel_id, notes, created_at)``.

    Unknown channels are ignored; a NULL note keeps the stored one; the first
    ``created_at`` stays.
    """
    known = requests.join(channels.select("channel_id"), "channel_id", "left_semi")
    incoming = known.select(
        "channel_id", F.col("notes").alias("new_notes"), F.col("created_at").alias("new_at")
    )
    return (
        watched.join(incoming, "channel_id", "full")
        .select(
            "channel_id",
            F.coalesce("new_notes", "notes").alias("notes"),
            F.coalesce("created_at", "new_at").alias("created_at"),
        )
    )


def unwatch(watched: DataFrame, removed: DataFrame) -> DataFrame:
    return watched.join(removed.select("channel_id"), "channel_id", "left_anti")


def niche_dossier(
    base: DataFrame, watched: DataFrame, limit: int = 10
) -> DataFrame:
    """Boards by size, engagement and price plus the watched channels, per niche.

    Long form with ``board`` and ``position``; the engagement board only takes
    channels at or above the integer part of the niche's median size.
    """
    standing = enriched(base).filter(F.col("niche_slug").isNotNull())
    medians = quantiles(
        unpivot(base.filter(F.col("niche_slug").isNotNull()), ["niche_slug"], ["subscribers"]).drop(
            "metric"
        ),
        ["niche_slug"],
        (0.5,),
    ).select("niche_slug", F.floor("q0").alias("engagement_floor"))
    floored = standing.join(medians, "niche_slug", "left")
    boards = [
        leaders(floored, "subscribers", limit).withColumn("board", F.lit("subscribers")),
        # Without any known size there is no floor to apply.
        leaders(
            floored.filter(
                F.col("engagement_floor").isNull()
                | (F.col("subscribers") >= F.col("engagement_floor"))
            ),
            "err",
            limit,
        ).withColumn("board", F.lit("engagement")),
        leaders(floored, "campaign_price", limit).withColumn("board", F.lit("price")),
    ]
    order = Window.partitionBy("niche_slug").orderBy(
        F.col("subscribers").desc_nulls_last(), "channel_id"
    )
    watched_rows = (
        floored.join(watched.select("channel_id"), "channel_id", "left_semi")
        .withColumn("position", F.row_number().over(order))
        .withColumn("board", F.lit("watched"))
    )
    result = watched_rows
    for board in boards:
        result = result.unionByName(board)
    return result
