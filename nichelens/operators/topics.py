"""Topic score: how good an event is as a topic, and what happens to it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelens.functions.lexicon import Lexicon, practical_value, relevance
from nichelens.functions.textkeys import fold_text, nfkc
from nichelens.functions.weighted import renormalized_mean, round_percent
from nichelens.operators.market import one_row
from nichelens.vocab import RESCORABLE_STATUSES, TRUST_AUTHORITY

# Components, labels, weights, half-lives, thresholds.
TOPIC_WEIGHTS = {
    "relevance": 0.22,
    "practical_value": 0.20,
    "novelty": 0.15,
    "authority": 0.13,
    "timeliness": 0.12,
    "audience_fit": 0.10,
    "content_potential": 0.08,
}
TOPIC_LABELS = {
    "relevance": "Relevance to the niche",
    "practical_value": "Practical value",
    "novelty": "Novelty",
    "authority": "Source authority",
    "timeliness": "Timeliness",
    "audience_fit": "Audience fit",
    "content_potential": "Content potential",
}
JUDGED = ("relevance", "practical_value", "audience_fit", "content_potential")
HALF_LIFE_HOURS = {
    "RELEASE": 48.0,
    "UPDATE": 72.0,
    "INCIDENT": 24.0,
    "NEW_TOOL": 168.0,
    "RESEARCH": 336.0,
    "GUIDE": 336.0,
    "OTHER": 120.0,
}


@dataclass(frozen=True)
class TopicRules:
    """Weights, decay and thresholds of one score version.

    ``note_terms`` is the number of matched terms a note lists; all of them by default.
    """

    version: str = "topic_score_v1"
    weights: dict[str, float] = field(default_factory=lambda: dict(TOPIC_WEIGHTS))
    half_life: dict[str, float] = field(default_factory=lambda: dict(HALF_LIFE_HOURS))
    selected: float = 70.0
    backlog: float = 45.0
    age_penalty_per_day: float = 8.0
    expire_after_days: int = 30
    lexicon: Lexicon | None = field(default_factory=Lexicon)
    note_terms: int | None = None


def _moment(now: str | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def _elapsed_seconds(now: Column, then: Column) -> Column:
    return F.greatest((F.unix_micros(now) - F.unix_micros(then)) / F.lit(1e6), F.lit(0.0))


def half_life_of(event_type: Column, rules: TopicRules) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.half_life.items() for x in kv])
    return F.coalesce(
        F.try_element_at(table, event_type), F.lit(rules.half_life.get("OTHER", 120.0))
    )


def timeliness(event_at: Column, event_type: Column, now: str | Column, rules: TopicRules) -> Column:
    """100 at publication, halved every half-life; future dates count as now."""
    hours = _elapsed_seconds(_moment(now), event_at) / 3600
    half = half_life_of(event_type, rules)
    decayed = round_percent(100 * F.pow(F.lit(0.5), hours / F.nullif(half, F.lit(0.0))))
    return F.when(half <= 0, F.lit(0.0)).otherwise(decayed)


def novelty(first_seen_at: Column, similar: Column, now: str | Column, rules: TopicRules) -> Column:
    """Loses points per day; nothing left for what was already published."""
    days = _elapsed_seconds(_moment(now), first_seen_at) / 86400
    fresh = round_percent(F.greatest(F.lit(0.0), 100 - days * rules.age_penalty_per_day))
    return F.when(similar, F.lit(0.0)).otherwise(fresh)


def authority(trust: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in TRUST_AUTHORITY.items() for x in (k, float(v))])
    return F.try_element_at(table, trust)


def score_clusters(
    clusters: DataFrame,
    now: str,
    verdicts: DataFrame | None = None,
    rules: TopicRules | None = None,
) -> DataFrame:
    """Scored clusters with ``components``, ``score`` and ``decision``.

    ``verdicts(cluster_key, relevance, practical_value, audience_fit,
    content_potential)`` are judgements made elsewhere; each beats the lexicon,
    and a component with neither hands its weight to the others.
    """
    rules = rules or TopicRules()
    moment = _moment(now)
    rows = clusters
    if "similar_to_published" not in rows.columns:
        rows = rows.withColumn("similar_to_published", F.lit(False))
    rows = rows.withColumn("_event", F.coalesce("event_type", F.lit("OTHER"))).withColumn(
        "_at", F.coalesce("event_at", "first_seen_at")
    )
    lexical: dict[str, Column] = {}
    if rules.lexicon is not None:
        rows = (
            rows.withColumn("_t", nfkc(F.col("canonical_title")))
            .withColumn("_s", nfkc(F.col("canonical_summary")))
            .withColumn("_title", fold_text(F.col("_t")))
            .withColumn("_summary", fold_text(F.col("_s")))
            .withColumn("_text", F.trim(F.concat_ws(" ", "_title", "_summary")))
            .withColumn("_rel", relevance(F.col("_text"), rules.lexicon))
            .withColumn(
                "_prac",
                practical_value(
                    F.col("_title"),
                    F.col("_summary"),
                    F.col("_event"),
                    F.coalesce(F.col("version") != "", F.lit(False)),
                    rules.lexicon,
                ),
            )
            .drop("_t", "_s", "_title", "_summary", "_text")
        )
        lexical = {"relevance": F.col("_rel.value"), "practical_value": F.col("_prac.value")}
    # Texts have been read by now: only what they gave meets the judgements.
    if verdicts is not None:
        judged = verdicts.select("cluster_key", *[F.col(k).alias(f"_llm_{k}") for k in JUDGED])
        rows = rows.join(judged, "cluster_key", "left")
    else:
        rows = rows.select("*", *[F.lit(None).cast("double").alias(f"_llm_{k}") for k in JUDGED])
    measured = {
        "authority": authority(F.col("max_trust")),
        "timeliness": timeliness(F.col("_at"), F.col("_event"), moment, rules),
        "novelty": novelty(F.col("first_seen_at"), F.col("similar_to_published"), moment, rules),
    }

    def note(key: str) -> Column:
        listed = lambda sign, terms: F.when(
            F.size(terms) > 0,
            F.concat(F.lit(sign), F.array_join(terms if rules.note_terms is None else F.slice(terms, 1, rules.note_terms), ", ")),
        )
        if key == "relevance":
            parts = F.concat_ws("; ", listed("+", F.col("_rel.matched")), listed("-", F.col("_rel.penalised")))
        else:
            parts = F.coalesce(listed("+", F.col("_prac.matched")), F.lit(""))
        return F.when(parts == "", F.lit("no lexicon terms matched")).otherwise(parts)

    def component(key: str, weight: float) -> Column:
        unknown = F.lit(None).cast("string")
        if key in measured:
            value, source, why = measured[key], F.lit("data"), unknown
        else:
            llm = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(f"_llm_{key}")))
            llm = F.when(F.col(f"_llm_{key}").isNotNull(), llm)
            if key in lexical:
                value = F.coalesce(llm, lexical[key])
                source = F.when(llm.isNotNull(), F.lit("llm")).otherwise(F.lit("lexicon"))
                why = F.when(llm.isNull(), note(key))
            else:
                value, source = llm, F.lit("llm")
                why = F.when(
                    llm.isNull(),
                    F.lit("no LLM judgement and no lexicon fallback for this component"),
                )
        return F.struct(
            F.lit(key).alias("key"),
            F.lit(TOPIC_LABELS.get(key, key)).alias("label"),
            source.alias("source"),
            F.lit(float(weight)).alias("weight"),
            value.alias("value"),
            value.isNotNull().alias("available"),
            why.alias("note"),
        )

    parts = F.array(*[component(k, w) for k, w in rules.weights.items()])
    scored = rows.withColumn("parts", parts).withColumn(
        "score", renormalized_mean(F.col("parts"))
    )
    keep = [c for c in clusters.columns if c not in ("score", "decision", "parts")]
    return scored.select(
        *keep,
        *([] if "similar_to_published" in keep else ["similar_to_published"]),
        "parts",
        "score",
        decision(F.col("score"), rules).alias("decision"),
        F.lit(rules.version).alias("score_version"),
        moment.alias("scored_at"),
    )


def decision(score: Column, rules: TopicRules) -> Column:
    """Thresholds on the rounded score; without a score the cluster stays open."""
    return (
        F.when(score.isNull(), F.lit("OPEN"))
        .when(score >= rules.selected, F.lit("SELECTED"))
        .when(score >= rules.backlog, F.lit("BACKLOG"))
        .otherwise(F.lit("FILTERED"))
    )


def needing_score(clusters: DataFrame, limit: int | None = None) -> DataFrame:
    """Clusters with a missing or stale score in a status a score may change."""
    due = clusters.filter(F.col("needs_rescore") & F.col("status").isin(*RESCORABLE_STATUSES))
    if limit is None:
        return due
    return due.orderBy(F.desc("last_seen_at"), "cluster_key").limit(limit)


def split_expired(clusters: DataFrame, now: str, rules: TopicRules | None = None) -> tuple[DataFrame, DataFrame]:
    """(alive, expired): clusters not seen for too long are closed unscored."""
    rules = rules or TopicRules()
    cutoff = _moment(now) - F.make_dt_interval(F.lit(rules.expire_after_days))
    old = F.col("last_seen_at") < cutoff
    return clusters.filter(~old), clusters.filter(old)


def rescore(
    clusters: DataFrame,
    now: str,
    verdicts: DataFrame | None = None,
    rules: TopicRules | None = None,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new cluster table, score history rows) of one scoring run."""
    rules = rules or TopicRules()
    due = needing_score(clusters, limit)
    alive, expired = split_expired(due, now, rules)
    scored = score_clusters(alive, now, verdicts, rules)
    history = score_history(scored, now)
    update = scored.select(
        "cluster_key",
        F.col("score").alias("u_score"),
        F.col("decision").alias("u_status"),
    ).unionByName(
        expired.select(
            "cluster_key",
            F.lit(None).cast("double").alias("u_score"),
            F.lit("EXPIRED").alias("u_status"),
        )
    )
    touched = F.col("u_status").isNotNull()
    judged = touched & (F.col("u_status") != "EXPIRED")
    base = clusters
    if "topic_score" not in base.columns:
        base = base.withColumn("topic_score", F.lit(None).cast("double"))
    table = (
        base.join(update, "cluster_key", "left")
        .withColumn("topic_score", F.when(judged, F.col("u_score")).otherwise(F.col("topic_score")))
        .withColumn("status", F.coalesce("u_status", "status"))
        .withColumn("needs_rescore", F.col("needs_rescore") & ~touched)
        .drop("u_score", "u_status")
    )
    return table, history


def score_history(scored: DataFrame, now: str) -> DataFrame:
    """Append-only rows of one run: score, decision, breakdown and inputs."""
    moment = _moment(now)
    fields = ["label", "source", "weight", "value", "available", "note"]
    breakdown = F.map_from_entries(
        F.transform("parts", lambda p: F.struct(p["key"], F.struct(*[p[f].alias(f) for f in fields])))
    )
    return scored.select(
        "cluster_key",
        "score_version",
        F.col("score").cast("decimal(5,2)").alias("score"),
        "decision",
        breakdown.alias("components"),
        F.struct(
            "cluster_key",
            "event_type",
            "max_trust",
            "item_count",
            F.coalesce("event_at", "first_seen_at").alias("event_at"),
            moment.alias("scored_at"),
            "similar_to_published",
        ).alias("inputs"),
        "item_count",
        F.to_date(moment).alias("as_of_date"),
        moment.alias("created_at"),
    )


def score_counters(scored: DataFrame, expired: DataFrame) -> DataFrame:
    """One row of run counters."""
    used = lambda source: F.bool_or(
        F.exists("parts", lambda p: p["available"] & (p["source"] == source))
    )
    counts = scored.agg(
        F.count("*").alias("clusters_scored"),
        F.count_if(F.col("decision") == "SELECTED").alias("selected"),
        F.count_if(F.col("decision") == "BACKLOG").alias("backlog"),
        F.count_if(F.col("decision") == "FILTERED").alias("filtered"),
        F.coalesce(used("llm"), F.lit(False)).alias("llm_used"),
        F.coalesce(used("lexicon"), F.lit(False)).alias("lexicon_used"),
    )
    return one_row(counts, expired.agg(F.count("*").alias("expired")))


def unavailable_components(scored: DataFrame) -> DataFrame:
    return (
        scored.select(F.explode(F.filter("parts", lambda p: ~p["available"])).alias("p"))
        .groupBy(F.col("p.key").alias("component"))
        .agg(F.count("*").alias("clusters"))
    )
