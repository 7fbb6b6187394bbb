"""Sources, items with revisions, and the read side of the research tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelens.functions.textkeys import (
    canonicalize_url,
    content_fingerprint,
    normalize_text,
    url_hash,
)
from nichelens.operators.market import one_row

REMOVED_REASON = "removed from the source whitelist"
SOURCE_FIELDS = ("name", "provider", "trust", "url", "enabled", "poll_interval_minutes")


def sync_sources(current: DataFrame, configured: DataFrame) -> DataFrame:
    """New version of the source table.

    Configured sources are created or overwritten; a source that left the
    configuration is disabled with a reason, never deleted. ``action`` says
    what happened.
    """
    wanted = configured.select(
        "key", *[F.col(c).alias(f"w_{c}") for c in SOURCE_FIELDS], F.lit(True).alias("wanted")
    )
    kept = current.withColumn("known", F.lit(True))
    joined = kept.join(wanted, "key", "full")
    is_wanted = F.col("wanted").isNotNull()
    dropped = ~is_wanted & F.col("enabled")
    values = [
        F.when(is_wanted, F.col(f"w_{c}")).otherwise(
            F.lit(False) if c == "enabled" else F.col(c)
        ).alias(c)
        for c in SOURCE_FIELDS
    ]
    return joined.select(
        "key",
        *values,
        F.when(dropped, F.lit(REMOVED_REASON)).otherwise(F.col("last_error")).alias("last_error"),
        "last_polled_at",
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"),
        F.when(F.col("known").isNull(), "created")
        .when(is_wanted, "updated")
        .when(dropped, "disabled")
        .otherwise("kept")
        .alias("action"),
    )


def is_due(last_polled_at: Column, interval_minutes: Column, now: str | Column) -> Column:
    """Never polled, or the interval has passed."""
    moment = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    due_at = F.unix_micros(last_polled_at) + interval_minutes.cast("bigint") * 60_000_000
    return last_polled_at.isNull() | (F.unix_micros(moment) >= due_at)


def with_identity(raw: DataFrame) -> DataFrame:
    """Add canonical URL, its hash and the content fingerprint; drop items without URL."""
    return (
        raw.withColumn("canonical_url", canonicalize_url(F.col("url")))
        .filter(F.col("canonical_url").isNotNull())
        .withColumn("url_hash", url_hash(F.col("canonical_url")))
        .withColumn(
            "content_fingerprint",
            content_fingerprint(
                normalize_text(F.col("title")),
                normalize_text(F.col("summary")),
                normalize_text(F.col("content_excerpt")),
            ),
        )
    )


def cap_per_source(raw: DataFrame, cap: int | None = None) -> DataFrame:
    """All items, or the first ``cap`` of a source in feed order (``arrival``)."""
    if cap is None:
        return raw
    order = Window.partitionBy("source_key").orderBy("arrival")
    return raw.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


ITEM_TEXT = ("title", "summary", "content_excerpt", "content_fingerprint")
#: Stated once, at the first sighting; metadata follows the text.
ITEM_FACTS = ("author", "publisher", "language", "trust")
ITEM_METADATA = ("raw_metadata",)


def with_hints(items: DataFrame) -> DataFrame:
    """``version_hint`` and ``product_hint`` from what the source itself says about a release."""
    tag, repo = (F.try_element_at("raw_metadata", F.lit(k)) for k in ("tag_name", "repo"))
    return items.withColumn("version_hint", tag).withColumn("product_hint", repo)


def store_items(
    arrivals: DataFrame, current: DataFrame | None = None, chunk: int = 1_000_000
) -> DataFrame:
    """New version of the item table after the ``arrivals`` (with identity).

    Per (source, external id) the arrivals replay in order: a changed
    fingerprint is a revision that replaces text and, when it carries one, the
    published date; the address of the first sighting stays, as do author,
    publisher, language and trust, while ``raw_metadata`` goes with the text;
    arrivals without these columns give items without them. ``action`` is NEW,
    UPDATED or UNCHANGED, and ``revised`` marks clusters to be rescored.

    ``arrival`` is a unique sequence number. An item seen without end is
    compared ``chunk`` arrivals at a time; only the last fingerprint of each
    chunk is carried over to the next.
    """
    keys = ["source_key", "external_id"]
    facts = [c for c in ITEM_FACTS if c in arrivals.columns]
    texts = [*ITEM_TEXT, *[c for c in ITEM_METADATA if c in arrivals.columns]]
    incoming = arrivals.select(
        *keys, "url", "canonical_url", "url_hash", *texts, *facts, "published_at",
        "arrived_at", "arrival", F.lit(1).alias("_fresh"), F.lit(0).alias("base_revision"),
    )
    if current is not None:
        incoming = incoming.unionByName(
            current.select(
                *keys, "url", "canonical_url", "url_hash", *texts, *facts, "published_at",
                F.col("discovered_at").alias("arrived_at"),
                F.lit(None).cast("bigint").alias("arrival"),
                F.lit(0).alias("_fresh"),
                F.col("revision").alias("base_revision"),
            )
        )
    turn = F.struct("_fresh", "arrival")
    parts = [*keys, "_chunk"]
    chunked = incoming.withColumn(
        "_chunk", F.coalesce(F.floor(F.col("arrival") / F.lit(chunk)), F.lit(-1))
    )
    inside = Window.partitionBy(*parts).orderBy("_fresh", "arrival")
    carried = (
        chunked.groupBy(*parts)
        .agg(F.max_by("content_fingerprint", turn).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")))
        .drop("_last")
    )
    seen = (
        chunked.withColumn("_within", F.lag("content_fingerprint").over(inside))
        .join(carried, parts)
        .withColumn("_before", F.coalesce("_within", "_carried"))
    )
    moved = seen.withColumn(
        "_changed",
        F.col("_before").isNotNull() & (F.col("_before") != F.col("content_fingerprint")),
    )
    # Only a first sighting or a revision may set the published date.
    speaks = F.col("_before").isNull() | F.col("_changed")
    latest = F.struct(*texts)
    first = F.struct("url", "canonical_url", "url_hash", *facts, F.col("arrived_at").alias("discovered_at"))
    state = moved.groupBy(*keys).agg(
        F.min_by(first, turn).alias("first"),
        F.max_by(latest, F.when(speaks, turn)).alias("latest"),
        F.max_by("published_at", F.when(speaks & F.col("published_at").isNotNull(), turn)).alias(
            "published_at"
        ),
        F.max(F.when(F.col("_changed"), F.col("arrived_at"))).alias("content_changed_at"),
        F.sum(F.col("_changed").cast("int")).alias("changes"),
        F.max(F.when(F.col("_fresh") == 0, F.col("base_revision"))).alias("stored_revision"),
        F.count_if(F.col("_fresh") == 1).alias("sightings"),
    )
    stored = F.col("stored_revision").isNotNull()
    return state.select(
        *keys,
        "first.*",
        "latest.*",
        "published_at",
        "content_changed_at",
        (F.coalesce("stored_revision", F.lit(1)) + F.col("changes")).cast("bigint").alias("revision"),
        F.when(~stored, "NEW")
        .when(F.col("changes") > 0, "UPDATED")
        .otherwise("UNCHANGED")
        .alias("action"),
        (stored & (F.col("changes") > 0)).alias("revised"),
        F.when(~stored, F.lit("NEW")).alias("status"),
        "changes",
        "sightings",
    )


def poll_counters(stored: DataFrame) -> DataFrame:
    """New, updated and unchanged sightings per source."""
    fresh = (F.col("action") == "NEW").cast("bigint")
    return stored.groupBy("source_key").agg(
        F.sum(fresh).alias("items_new"),
        F.sum("changes").alias("items_updated"),
        F.sum(F.col("sightings") - F.col("changes") - fresh).alias("items_unchanged"),
    )


def source_health(sources: DataFrame, polls: DataFrame) -> DataFrame:
    """New source state after ``polls(key, polled_at, error)``.

    A success clears the failure count and the error; failures after the last
    success add up.
    """
    ok = F.col("error").isNull()
    marked = polls.join(
        polls.groupBy("key").agg(F.max(F.when(ok, F.col("polled_at"))).alias("last_ok")), "key"
    )
    failing = ~ok & (F.col("last_ok").isNull() | (F.col("polled_at") > F.col("last_ok")))
    summary = marked.groupBy("key").agg(
        F.max("polled_at").alias("p_polled"),
        F.max("last_ok").alias("p_ok"),
        F.count_if(failing).alias("p_failures"),
        F.max_by("error", F.when(failing, F.col("polled_at"))).alias("p_error"),
    )
    carried = F.when(F.col("p_ok").isNull(), F.coalesce("consecutive_failures", F.lit(0))).otherwise(0)
    polled = F.col("p_polled").isNotNull()
    return sources.join(summary, "key", "left").select(
        "key",
        F.coalesce("p_polled", "last_polled_at").alias("last_polled_at"),
        F.coalesce("p_ok", "last_success_at").alias("last_success_at"),
        F.when(polled, carried + F.col("p_failures"))
        .otherwise(F.coalesce("consecutive_failures", F.lit(0)))
        .alias("consecutive_failures"),
        F.when(polled, F.col("p_error"))
        .otherwise(F.col("last_error"))
        .alias("last_error"),
    )


def flag_revised(clusters: DataFrame, members: DataFrame, stored: DataFrame) -> DataFrame:
    """Clusters with ``needs_rescore`` raised where one of their items was revised."""
    revised = (
        members.join(stored.filter("revised").select("item_id"), "item_id", "left_semi")
        .select("cluster_key")
        .distinct()
        .withColumn("_revised", F.lit(True))
    )
    return (
        clusters.join(revised, "cluster_key", "left")
        .withColumn(
            "needs_rescore", F.col("needs_rescore") | F.coalesce("_revised", F.lit(False))
        )
        .drop("_revised")
    )


# ------------------------------------------------------------------- reads


def top(clusters: DataFrame, statuses: tuple[str, ...] | None = None, limit: int = 20) -> DataFrame:
    """Best clusters first; unscored last."""
    rows = clusters if not statuses else clusters.filter(F.col("status").isin(*statuses))
    return rows.orderBy(
        F.col("topic_score").desc_nulls_last(), F.desc("last_seen_at"), "cluster_key"
    ).limit(limit)


def counts_by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("rows"))


def latest_score(history: DataFrame) -> DataFrame:
    """Newest score row of every cluster."""
    payload = [c for c in history.columns if c != "cluster_key"]
    return (
        history.groupBy("cluster_key")
        .agg(F.max_by(F.struct(*payload), F.col("created_at")).alias("s"))
        .select("cluster_key", "s.*")
    )


def source_breakdown(members: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Which sources reported each cluster, primary report first."""
    return (
        members.join(items.select("item_id", "source_key", "trust", "url", "title"), "item_id")
        .join(sources.select(F.col("key").alias("source_key"), F.col("name").alias("source")), "source_key")
        .select(
            "cluster_key", "source", "trust", "role", "matched_by", "url", "title", "item_id"
        )
        .orderBy("cluster_key", "role", "item_id")
    )


def research_status(sources: DataFrame, items: DataFrame, clusters: DataFrame) -> DataFrame:
    return one_row(
        sources.agg(
            F.count("*").alias("sources_total"), F.count_if("enabled").alias("sources_enabled")
        ),
        items.agg(F.count("*").alias("items_total")),
        clusters.agg(F.count("*").alias("clusters_total")),
    )


def digest(
    clusters: DataFrame, history: DataFrame, breakdown: DataFrame, limit: int = 15
) -> DataFrame:
    """Selected topics with their latest components and sources."""
    chosen = top(clusters, ("SELECTED",), limit).select(
        "cluster_key", "canonical_title", "topic_score", "item_count", "last_seen_at"
    )
    # The report holds a few topics; their sources are listed after the cut.
    sources = (
        breakdown.join(chosen.select("cluster_key"), "cluster_key", "left_semi")
        .groupBy("cluster_key")
        .agg(F.array_sort(F.collect_set("source")).alias("sources"))
    )
    latest = latest_score(
        history.join(chosen.select("cluster_key"), "cluster_key", "left_semi")
    ).select("cluster_key", "decision", "components")
    return (
        chosen.join(latest, "cluster_key", "left")
        .join(sources, "cluster_key", "left")
        .orderBy(F.col("topic_score").desc_nulls_last(), F.desc("last_seen_at"), "cluster_key")
    )


def run_audit(
    job: str, counters: DataFrame, started_at: str, finished_at: str, failed: Column | None = None
) -> DataFrame:
    """One row for the run ledger; PARTIAL when anything failed."""
    start, end = (F.lit(t).cast("timestamp") for t in (started_at, finished_at))
    broken = F.lit(False) if failed is None else failed
    return counters.select(
        F.lit(job).alias("job"),
        F.when(broken, "PARTIAL").otherwise("SUCCESS").alias("status"),
        start.alias("started_at"),
        end.alias("finished_at"),
        ((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("bigint").alias("duration_ms"),
        F.to_json(F.struct(*counters.columns)).alias("counters"),
    )
