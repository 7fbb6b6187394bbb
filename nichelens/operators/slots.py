"""Posting slots: which are open, which are filled, what goes out next.

Wall-clock times are Moscow time (UTC+3 all year); instants are UTC.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelens.operators.research import top
from nichelens.vocab import FIRST_HAND_TRUST, OCCUPYING_STATUSES

MOSCOW_HOURS = 3


@dataclass(frozen=True)
class SlotRules:
    """Daily cadence and the bar for breaking news."""

    slots: tuple[str, ...] = ("09:00", "14:00", "19:00")
    window_minutes: int = 180
    own_slots: tuple[int, ...] = (1,)
    max_topic_age_hours: int | None = 48
    breaking_enabled: bool = True
    breaking_min_score: float = 90.0
    breaking_max_age_minutes: int = 240
    breaking_min_sources: int = 2
    breaking_max_per_day: int = 2
    breaking_min_gap_minutes: int = 90


def parse_slots(spec: str) -> tuple[str, ...]:
    """``"09:00,14:00"`` to sorted, distinct ``HH:MM`` times."""
    times = set()
    for chunk in filter(None, (part.strip() for part in spec.split(","))):
        hour, _, minute = chunk.partition(":")
        if not (hour.isdigit() and minute.isdigit() and int(hour) < 24 and int(minute) < 60):
            raise ValueError(f"bad slot time {chunk!r}, expected HH:MM")
        times.add(f"{int(hour):02d}:{int(minute):02d}")
    if not times:
        raise ValueError("no posting slots configured")
    return tuple(sorted(times))


def moscow_date(instant: Column) -> Column:
    return F.to_date(instant + F.make_dt_interval(hours=F.lit(MOSCOW_HOURS)))


def _minutes(clock: str) -> int:
    return int(clock[:2]) * 60 + int(clock[3:])


def slot_array(day: Column, rules: SlotRules) -> Column:
    """``array<struct<slot_index, starts_at, ends_at>>`` of one Moscow day, in UTC."""
    midnight = F.unix_seconds(day.cast("timestamp")) - MOSCOW_HOURS * 3600
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("slot_index"),
                F.timestamp_seconds(midnight + _minutes(t) * 60).alias("starts_at"),
                F.timestamp_seconds(midnight + (_minutes(t) + rules.window_minutes) * 60).alias(
                    "ends_at"
                ),
            )
            for i, t in enumerate(rules.slots)
        ]
    )


def slots_for_days(days: DataFrame, rules: SlotRules) -> DataFrame:
    """Every slot of every Moscow ``day``."""
    return days.select("day", F.inline(slot_array(F.col("day"), rules)))


def upcoming(spark, now: str, days: int, rules: SlotRules) -> DataFrame:
    """Slots not over yet, from today on."""
    moment = F.lit(now).cast("timestamp")
    today = moscow_date(moment)
    calendar = spark.range(1).select(
        F.explode(F.sequence(today, F.date_add(today, days - 1))).alias("day")
    )
    return slots_for_days(calendar, rules).filter(F.col("ends_at") > moment)


def open_slot(instant: Column, rules: SlotRules) -> Column:
    """The slot whose window holds the instant, the newest on overlap, else NULL.

    Windows of earlier days that run over midnight count. Slots are a function
    of the day, so this as-of lookup needs no join.
    """
    return F.try_element_at(_holding(instant, rules), F.lit(-1))


def occupying(publications: DataFrame) -> DataFrame:
    return publications.filter(F.col("status").isin(*OCCUPYING_STATUSES))


def filled_slots(slots: DataFrame, publications: DataFrame, rules: SlotRules) -> DataFrame:
    """Slots with ``posts`` and ``filled``.

    A post can only fall into slots of its own Moscow day or of the days a
    window reaches back to, so the interval join becomes an equality on the
    slot key. Posts fold per slot before they move.
    """
    posts = (
        occupying(publications)
        .select(F.explode(_holding(F.col("created_at"), rules)).alias("s"))
        .groupBy("s.starts_at", "s.slot_index")
        .agg(F.count("*").alias("posts"))
    )
    return (
        slots.join(posts, ["starts_at", "slot_index"], "left")
        .withColumn("posts", F.coalesce("posts", F.lit(0)))
        .withColumn("filled", F.col("posts") > 0)
    )


def unpublished_clusters(clusters: DataFrame, publications: DataFrame) -> DataFrame:
    used = occupying(publications).filter(F.col("cluster_key").isNotNull()).select("cluster_key").distinct()
    return clusters.join(used, "cluster_key", "left_anti")


def unpublished_topics(topics: DataFrame, publications: DataFrame) -> DataFrame:
    """Own topics left, in backlog order (``position``)."""
    used = occupying(publications).filter(F.col("topic_key") != "").select("topic_key").distinct()
    return topics.join(used, "topic_key", "left_anti").orderBy("position")


def _selected(clusters: DataFrame) -> DataFrame:
    return clusters.filter(F.col("status") == "SELECTED")


def supply(clusters: DataFrame, publications: DataFrame, limit: int | None = None) -> DataFrame:
    """Selected clusters not yet published; the ``limit`` best of them if asked."""
    left = unpublished_clusters(_selected(clusters), publications)
    return left if limit is None else top(left, None, limit)


def _age_seconds(now: str) -> Column:
    seen = F.coalesce("event_at", "first_seen_at")
    return F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(seen)


def next_cluster(
    clusters: DataFrame, publications: DataFrame, now: str, rules: SlotRules
) -> DataFrame:
    """Best of all selected clusters that are still unpublished and fresh."""
    rows = supply(clusters, publications)
    if rules.max_topic_age_hours is not None:
        rows = rows.filter(
            F.coalesce(_age_seconds(now) <= rules.max_topic_age_hours * 3600, F.lit(True))
        )
    return top(rows, None, 1)


def breaking_gate(publications: DataFrame, now: str, rules: SlotRules) -> DataFrame:
    """One row: breaking posts today (Moscow day), seconds since the last post, open or not."""
    moment = F.lit(now).cast("timestamp")
    day_start = F.timestamp_seconds(
        F.unix_seconds(moscow_date(moment).cast("timestamp")) - MOSCOW_HOURS * 3600
    )
    today = F.count_if((F.col("created_at") >= day_start) & F.col("is_breaking"))
    gap = (F.unix_micros(moment) - F.unix_micros(F.max("created_at"))) / F.lit(1e6)
    return (
        occupying(publications)
        .agg(today.alias("breaking_today"), gap.alias("seconds_since_last"))
        .withColumn(
            "gate_open",
            F.lit(rules.breaking_enabled)
            & (F.col("breaking_today") < rules.breaking_max_per_day)
            & (
                F.col("seconds_since_last").isNull()
                | (F.col("seconds_since_last") >= rules.breaking_min_gap_minutes * 60)
            ),
        )
    )


def breaking_candidates(
    clusters: DataFrame,
    publications: DataFrame,
    now: str,
    rules: SlotRules,
    limit: int | None = None,
) -> DataFrame:
    """Clusters that may jump the queue: hot, fresh and confirmed; the ``limit`` best if asked."""
    confirmed = (F.col("item_count") >= rules.breaking_min_sources) | F.col("max_trust").isin(
        *FIRST_HAND_TRUST
    )
    fit = (
        supply(clusters, publications)
        .filter(F.col("topic_score") >= rules.breaking_min_score)
        .filter(_age_seconds(now) <= rules.breaking_max_age_minutes * 60)
        .filter(confirmed)
    )
    gate = breaking_gate(publications, now, rules).select("gate_open")
    open_now = fit.filter(gate.scalar())
    return open_now if limit is None else top(open_now, None, limit)


def slot_action(
    instants: DataFrame,
    publications: DataFrame,
    rules: SlotRules,
    has_breaking: Column | None = None,
    has_cluster: Column | None = None,
    has_topic: Column | None = None,
) -> DataFrame:
    """What a run at each instant would do.

    ``has_*`` say whether breaking news, a cluster or an own topic is available.
    Order: breaking news, no slot, slot taken, own topic in its reserved slot,
    cluster, own topic, nothing.
    """
    hot, news, own = (
        F.lit(False) if flag is None else flag for flag in (has_breaking, has_cluster, has_topic)
    )
    placed = instants.withColumn("slot", open_slot(F.col("instant"), rules)).select(
        "*",
        F.col("slot.slot_index").alias("slot_index"),
        F.col("slot.starts_at").alias("starts_at"),
        F.col("slot.ends_at").alias("ends_at"),
    )
    # Earliest post per slot: an instant finds its slot taken if one precedes it.
    first_posts = (
        occupying(publications)
        .select("created_at", F.explode(_holding(F.col("created_at"), rules)).alias("s"))
        .groupBy(F.col("s.starts_at").alias("starts_at"))
        .agg(F.min("created_at").alias("first_post"))
    )
    taken = F.coalesce(F.col("first_post") <= F.col("instant"), F.lit(False))
    reserved = F.col("slot_index").isin(*rules.own_slots)
    action = (
        F.when(hot, "BREAKING")
        .when(F.col("slot_index").isNull(), "NO_SLOT")
        .when(taken, "ALREADY_FILLED")
        .when(reserved & own, "OWN_TOPIC")
        .when(news, "CLUSTER")
        .when(own, "OWN_TOPIC")
        .otherwise("NO_TOPIC")
    )
    return placed.join(first_posts, "starts_at", "left").withColumn("action", action).drop("slot", "first_post")


def _holding(instant: Column, rules: SlotRules) -> Column:
    today = moscow_date(instant)
    reach = max(_minutes(t) for t in rules.slots) + rules.window_minutes
    days = range(max(1, reach // 1440), -1, -1)
    slots = F.flatten(F.array(*[slot_array(F.date_sub(today, n), rules) for n in days]))
    return F.filter(slots, lambda s: (s["starts_at"] <= instant) & (instant < s["ends_at"]))


def publication_log(publications: DataFrame, limit: int = 20) -> DataFrame:
    return publications.orderBy(F.desc("created_at"), "publication_id").limit(limit)


def publications_by_slot(publications: DataFrame, rules: SlotRules) -> DataFrame:
    """Posts per slot index and Moscow day, for tracking the cadence."""
    slot = open_slot(F.col("created_at"), rules)
    rows = occupying(publications).select(
        moscow_date(F.col("created_at")).alias("day"), slot["slot_index"].alias("slot_index")
    )
    return rows.groupBy("day", "slot_index").agg(F.count("*").alias("posts"))


__all__ = [
    "SlotRules", "breaking_candidates", "breaking_gate", "filled_slots", "next_cluster",
    "open_slot", "parse_slots", "publication_log", "publications_by_slot", "slot_action",
    "slots_for_days", "supply", "unpublished_clusters", "unpublished_topics", "upcoming",
]
