"""Ledger and posting-slot questions on the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelens.operators import ledger as led
from nichelens.operators import slots as slt
from nichelens.plans import domain as d
from nichelens.plans.document_queries import SCORED, scored_clusters, scsql
from nichelens.plans.registry import query, text

RULES = slt.SlotRules()


def esql(needed: str, body: str) -> str:
    return d.with_views(d.EVENT_SQL, needed, body)


def calls(spark, sf_dir) -> DataFrame:
    return led.estimate_cost(d.llm_calls(spark, sf_dir), led.price_table(spark))


def micros(name: str, out: str):
    """Money as whole millionths, so both sides compare integers."""
    return (F.col(name) * 1_000_000).cast("bigint").alias(out)


# ------------------------------------------------------------------- ledger


@query("estimate_cost", esql("v_calls v_units", "SELECT call_id, model, micros FROM v_units"))
def estimate_cost(spark, sf_dir):
    return calls(spark, sf_dir).select("call_id", "model", micros("estimated_cost_usd", "micros"))


@query(
    "spend",
    esql(
        "v_calls v_units",
        """SELECT CAST(coalesce(sum(micros), 0) AS BIGINT) AS micros FROM v_units
            WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00'""",
    ),
)
def spend(spark, sf_dir):
    return led.spend(calls(spark, sf_dir), "2024-01-15 00:00:00").select(micros("spent_usd", "micros"))


DAYS_SQL = """, days AS (SELECT CAST(created_at AS DATE) AS day, CAST(sum(micros) AS BIGINT) AS day_micros,
    count(*) AS calls FROM v_units GROUP BY 1),
months AS (SELECT *, CAST(sum(day_micros) OVER (PARTITION BY date_trunc('month', day) ORDER BY day)
    AS BIGINT) AS month_micros FROM days)"""


@query(
    "daily_spend",
    esql(
        "v_calls v_units",
        f"{DAYS_SQL} SELECT CAST(day AS VARCHAR) AS day, day_micros, month_micros, calls FROM months",
    ),
)
def daily_spend(spark, sf_dir):
    return led.daily_spend(calls(spark, sf_dir)).select(
        text("day"), micros("day_usd", "day_micros"), micros("month_to_date_usd", "month_micros"), "calls"
    )


@query(
    "limit_check",
    esql(
        "v_calls v_units",
        f"""{DAYS_SQL} SELECT CAST(day AS VARCHAR) AS day, CASE WHEN day_micros >= 2000000 THEN 'daily'
            WHEN month_micros >= 5000000 THEN 'monthly' END AS blocked_by FROM months""",
    ),
)
def limit_check(spark, sf_dir):
    daily = led.daily_spend(calls(spark, sf_dir))
    return led.limit_check(daily, "2.00", "5.00").select(text("day"), "blocked_by")


@query(
    "daily_requests",
    esql(
        "v_calls",
        """SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, model, count(*) AS requests,
            count(*) >= 20 AS quota_spent FROM v_calls WHERE status = 'SUCCESS' GROUP BY 1, 2""",
    ),
)
def daily_requests(spark, sf_dir):
    return led.daily_requests(d.llm_calls(spark, sf_dir)).select(
        text("day"), "model", "requests", "quota_spent"
    )


# -------------------------------------------------------------------- slots


def _clock(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def posting_days(spark, sf_dir) -> DataFrame:
    return d.table(spark, sf_dir, "events").select(slt.moscow_date(F.col("ts")).alias("day")).distinct()


def slot_table(spark, sf_dir) -> DataFrame:
    return slt.slots_for_days(posting_days(spark, sf_dir), RULES)


SLOT_OUT = """CAST(day AS VARCHAR) AS day, slot_index,
    strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts_at,
    strftime(ends_at, '%Y-%m-%d %H:%M:%S') AS ends_at"""


def _slot_out(df: DataFrame, *more) -> DataFrame:
    return df.select(
        text("day"), F.col("slot_index").cast("bigint").alias("slot_index"), _clock("starts_at"),
        _clock("ends_at"), *more,
    )


@query("slots_for_days", esql("v_days v_slots", f"SELECT {SLOT_OUT} FROM v_slots"))
def slots_for_days(spark, sf_dir):
    return _slot_out(slot_table(spark, sf_dir))


@query(
    "upcoming_slots",
    esql(
        "v_days v_slots",
        f"""SELECT {SLOT_OUT} FROM v_slots
            WHERE ends_at > (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)""",
    ),
)
def upcoming_slots(spark, sf_dir):
    """Slots of the calendar that are not over at the middle of the recorded time."""
    events = d.table(spark, sf_dir, "events")
    middle = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2"))
    return _slot_out(slot_table(spark, sf_dir).filter(F.col("ends_at") > middle.scalar()))


@query(
    "open_slot",
    esql(
        "v_days v_slots",
        """SELECT event_id, slot_index, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts_at
            FROM events LEFT JOIN v_slots ON starts_at <= ts AND ts < ends_at""",
    ),
)
def open_slot(spark, sf_dir):
    slot = slt.open_slot(F.col("ts"), RULES)
    rows = d.table(spark, sf_dir, "events").select("event_id", slot.alias("s"))
    return rows.select(
        "event_id",
        F.col("s.slot_index").cast("bigint").alias("slot_index"),
        F.date_format("s.starts_at", "yyyy-MM-dd HH:mm:ss").alias("starts_at"),
    )


@query(
    "upcoming",
    """WITH t AS (SELECT max(ts) AS now FROM events),
        days AS (SELECT now, CAST(now + INTERVAL 3 HOUR AS DATE) + CAST(i AS INTEGER) AS day
            FROM t, (SELECT unnest(range(3)) AS i)),
        s AS (SELECT now, day, i AS slot_index, CAST(day AS TIMESTAMP) + to_hours(h - 3) AS starts_at
            FROM days, (VALUES (0, 9), (1, 14), (2, 19)) AS c(i, h))
        SELECT CAST(day AS VARCHAR) AS day, slot_index, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts_at
        FROM s WHERE starts_at + INTERVAL 180 MINUTE > now""",
)
def upcoming(spark, sf_dir):
    """Slots of three days from the last event on."""
    now = d.table(spark, sf_dir, "events").agg(F.max("ts").cast("string")).first()[0]
    return slt.upcoming(spark, now or d.NOW, 3, RULES).select(
        text("day"), F.col("slot_index").cast("bigint").alias("slot_index"),
        F.date_format("starts_at", "yyyy-MM-dd HH:mm:ss").alias("starts_at"),
    )


@query(
    "slot_filled",
    esql(
        "v_posts v_days v_slots",
        f"""SELECT {SLOT_OUT}, count(publication_id) AS posts, count(publication_id) > 0 AS filled
            FROM v_slots LEFT JOIN v_posts ON status IN ('PUBLISHED', 'SIMULATED')
                AND starts_at <= created_at AND created_at < ends_at
            GROUP BY day, slot_index, starts_at, ends_at""",
    ),
)
def slot_filled(spark, sf_dir):
    posts = d.publications(spark, sf_dir)
    found = slt.filled_slots(slot_table(spark, sf_dir), posts, RULES)
    return _slot_out(found, "posts", "filled")


def cluster_posts(spark, sf_dir) -> DataFrame:
    """Posts that used a cluster: every cluster whose primary report came from the posted source."""
    items = d.items(spark, sf_dir).select(
        F.col("item_id").alias("primary_item_id"), "source_key"
    )
    used = (
        slt.occupying(d.publications(spark, sf_dir))
        .filter(F.col("source_key").isNotNull() & F.col("source_key").isin("src3", "src8", "src14"))
        .select("source_key", "status")
        .distinct()
    )
    return (
        scored_clusters(spark, sf_dir)
        .select("cluster_key", "primary_item_id")
        .join(items, "primary_item_id")
        .join(used, "source_key")
        .select("cluster_key", "status")
    )


POSTED = """, free AS (SELECT * FROM decided WHERE primary_source NOT IN (SELECT source_key FROM posts
    WHERE source_key IN ('src3', 'src8', 'src14')))"""


@query(
    "unpublished_clusters",
    scsql(f"{SCORED} posts", f"{POSTED} SELECT cluster_key, decision AS status FROM free"),
)
def unpublished_clusters(spark, sf_dir):
    return slt.unpublished_clusters(
        scored_clusters(spark, sf_dir), cluster_posts(spark, sf_dir)
    ).select("cluster_key", "status")


@query(
    "unpublished_topics",
    esql(
        "v_posts",
        """SELECT topic_key, position FROM (SELECT 'topic-' || CAST(c_custkey AS VARCHAR) AS topic_key,
            c_custkey AS position FROM customer) WHERE topic_key NOT IN (SELECT topic_key FROM v_posts
            WHERE status IN ('PUBLISHED', 'SIMULATED') AND topic_key IS NOT NULL)""",
    ),
)
def unpublished_topics(spark, sf_dir):
    topics = d.table(spark, sf_dir, "customer").selectExpr(
        "concat('topic-', cast(c_custkey AS string)) AS topic_key", "c_custkey AS position"
    )
    return slt.unpublished_topics(topics, d.publications(spark, sf_dir))


BEST = "ORDER BY score DESC NULLS LAST, last_seen_at DESC, cluster_key"


@query(
    "topic_supply",
    scsql(
        f"{SCORED} posts",
        f"""{POSTED}, best AS (SELECT * FROM decided WHERE decision = 'SELECTED')
        SELECT cluster_key, score FROM best WHERE cluster_key IN (SELECT cluster_key FROM free)""",
    ),
)
def topic_supply(spark, sf_dir):
    found = slt.supply(scored_clusters(spark, sf_dir), cluster_posts(spark, sf_dir))
    return found.select("cluster_key", F.col("topic_score").alias("score"))


@query(
    "next_cluster",
    scsql(
        f"{SCORED} posts",
        f"""{POSTED}, best AS (SELECT * FROM decided WHERE decision = 'SELECTED')
        SELECT cluster_key, score FROM best WHERE cluster_key IN (SELECT cluster_key FROM free)
            AND epoch(TIMESTAMP '{d.NOW}') - epoch(event_at) <= 48 * 3600 {BEST} LIMIT 1""",
    ),
)
def next_cluster(spark, sf_dir):
    found = slt.next_cluster(
        scored_clusters(spark, sf_dir), cluster_posts(spark, sf_dir), d.NOW, RULES
    )
    return found.select("cluster_key", F.col("topic_score").alias("score"))


GATE_NOW = "2024-01-20 12:00:00"


@query(
    "breaking_gate",
    esql(
        "v_posts",
        f"""SELECT *, breaking_today < 2 AND (seconds_since_last IS NULL OR seconds_since_last >= 5400)
            AS gate_open FROM (SELECT count(*) FILTER (WHERE is_breaking AND created_at
                >= TIMESTAMP '2024-01-19 21:00:00') AS breaking_today,
            round((epoch_us(TIMESTAMP '{GATE_NOW}') - epoch_us(max(created_at))) / 1000000.0::DOUBLE, 3)
                AS seconds_since_last
            FROM v_posts WHERE status IN ('PUBLISHED', 'SIMULATED'))""",
    ),
)
def breaking_gate(spark, sf_dir):
    """The gate at one instant over all posts, those after it included, as the ledger has them."""
    found = slt.breaking_gate(d.publications(spark, sf_dir), GATE_NOW, RULES)
    return found.withColumn("seconds_since_last", F.round("seconds_since_last", 3))


EASY = slt.SlotRules(breaking_min_score=60.0, breaking_max_age_minutes=60 * 24 * 9)


@query(
    "breaking_candidates",
    scsql(
        f"{SCORED} posts",
        f"""{POSTED}, best AS (SELECT * FROM decided WHERE decision = 'SELECTED')
        SELECT cluster_key, score FROM best WHERE cluster_key IN (SELECT cluster_key FROM free)
            AND score >= 60 AND (item_count >= 2 OR max_trust IN ('OFFICIAL', 'PRIMARY'))
            AND epoch(TIMESTAMP '{d.NOW}') - epoch(event_at) <= 60 * 60 * 24 * 9""",
    ),
)
def breaking_candidates(spark, sf_dir):
    posts = cluster_posts(spark, sf_dir).withColumns(
        {
            "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp"),
            "is_breaking": F.lit(False),
        }
    )
    found = slt.breaking_candidates(scored_clusters(spark, sf_dir), posts, d.NOW, EASY)
    return found.select("cluster_key", F.col("topic_score").alias("score"))


# The same questions with posts of clusters named by their primary item: every event is the post of the item of
# its number, so that any cluster may be posted, whatever its source.


def posts_by_item(spark, sf_dir) -> DataFrame:
    posts = d.table(spark, sf_dir, "events").select(F.col("event_id").alias("publication_id"), F.col("event_id").alias("primary_item_id"))
    known = scored_clusters(spark, sf_dir).select("cluster_key", "primary_item_id")
    return d.publications(spark, sf_dir).join(posts.join(known, "primary_item_id"), "publication_id")


FREE_BY_ITEM = """, free AS (SELECT * FROM decided WHERE primary_item_id NOT IN (SELECT event_id FROM events
    WHERE event_type IN ('purchase', 'signup')))"""


@query(
    "unpublished_clusters_by_item",
    scsql(SCORED, f"{FREE_BY_ITEM} SELECT cluster_key, decision AS status FROM free"),
)
def unpublished_clusters_by_item(spark, sf_dir):
    found = slt.unpublished_clusters(scored_clusters(spark, sf_dir), posts_by_item(spark, sf_dir))
    return found.select("cluster_key", "status")


@query(
    "topic_supply_by_item",
    scsql(SCORED, f"{FREE_BY_ITEM} SELECT cluster_key, score FROM free WHERE decision = 'SELECTED'"),
)
def topic_supply_by_item(spark, sf_dir):
    found = slt.supply(scored_clusters(spark, sf_dir), posts_by_item(spark, sf_dir))
    return found.select("cluster_key", F.col("topic_score").alias("score"))


@query(
    "next_cluster_by_item",
    scsql(
        SCORED,
        f"""{FREE_BY_ITEM} SELECT cluster_key, score FROM free WHERE decision = 'SELECTED'
            AND epoch(TIMESTAMP '{d.NOW}') - epoch(event_at) <= 48 * 3600 {BEST} LIMIT 1""",
    ),
)
def next_cluster_by_item(spark, sf_dir):
    found = slt.next_cluster(scored_clusters(spark, sf_dir), posts_by_item(spark, sf_dir), d.NOW, RULES)
    return found.select("cluster_key", F.col("topic_score").alias("score"))


@query(
    "breaking_candidates_by_item",
    scsql(
        SCORED,
        f"""{FREE_BY_ITEM} SELECT cluster_key, score FROM free WHERE decision = 'SELECTED'
            AND score >= 60 AND (item_count >= 2 OR max_trust IN ('OFFICIAL', 'PRIMARY'))
            AND epoch(TIMESTAMP '{d.NOW}') - epoch(event_at) <= 60 * 60 * 24 * 9""",
    ),
)
def breaking_candidates_by_item(spark, sf_dir):
    """With rules under which the gate stays open whatever was posted; posts keep their times and flags."""
    rules = slt.SlotRules(
        breaking_min_score=60.0, breaking_max_age_minutes=60 * 24 * 9, breaking_max_per_day=1 << 30, breaking_min_gap_minutes=-(1 << 24)
    )
    found = slt.breaking_candidates(scored_clusters(spark, sf_dir), posts_by_item(spark, sf_dir), d.NOW, rules)
    return found.select("cluster_key", F.col("topic_score").alias("score"))


@query(
    "slot_action",
    esql(
        "v_posts v_days v_slots",
        """, first_posts AS (SELECT starts_at, min(created_at) AS first_post FROM v_slots JOIN v_posts
            ON status IN ('PUBLISHED', 'SIMULATED')
                AND starts_at <= created_at AND created_at < ends_at GROUP BY starts_at)
        SELECT event_id, CASE WHEN value > 300 THEN 'BREAKING' WHEN slot_index IS NULL THEN 'NO_SLOT'
            WHEN first_post <= ts THEN 'ALREADY_FILLED'
            WHEN slot_index = 1 AND user_id % 3 = 0 THEN 'OWN_TOPIC'
            WHEN user_id % 2 = 0 THEN 'CLUSTER' WHEN user_id % 3 = 0 THEN 'OWN_TOPIC'
            ELSE 'NO_TOPIC' END AS action
        FROM events LEFT JOIN v_slots ON starts_at <= ts AND ts < ends_at
        LEFT JOIN first_posts USING (starts_at)""",
    ),
)
def slot_action(spark, sf_dir):
    instants = d.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("instant"), "value", "user_id"
    )
    found = slt.slot_action(
        instants,
        d.publications(spark, sf_dir),
        RULES,
        has_breaking=F.col("value") > 300,
        has_cluster=F.col("user_id") % 2 == 0,
        has_topic=F.col("user_id") % 3 == 0,
    )
    return found.select("event_id", "action")


@query(
    "publication_log",
    esql(
        "v_posts",
        """SELECT publication_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
            FROM v_posts ORDER BY v_posts.created_at DESC, publication_id LIMIT 20""",
    ),
)
def publication_log(spark, sf_dir):
    return slt.publication_log(d.publications(spark, sf_dir)).select(
        "publication_id", "status", _clock("created_at")
    )


@query(
    "posts_by_slot",
    esql(
        "v_posts v_days v_slots",
        """SELECT CAST(CAST(created_at + INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS day, slot_index,
            count(*) AS posts FROM v_posts
            LEFT JOIN v_slots ON starts_at <= created_at AND created_at < ends_at
            WHERE status IN ('PUBLISHED', 'SIMULATED') GROUP BY 1, 2""",
    ),
)
def posts_by_slot(spark, sf_dir):
    return slt.publications_by_slot(d.publications(spark, sf_dir), RULES).select(
        text("day"), F.col("slot_index").cast("bigint").alias("slot_index"), "posts"
    )
