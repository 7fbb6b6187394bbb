"""Market, niche and competitor questions on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelens.functions.stats import unpivot
from nichelens.operators import competitors as cmp
from nichelens.operators import market as mkt
from nichelens.operators import niches as nsc
from nichelens.operators import sketches, textindex
from nichelens.plans import domain as d
from nichelens.plans.registry import query, rounded, text
from nichelens.session import shared_folder
from nichelens.sources import sinks

METRIC_COLUMNS = (
    "median_subscribers", "p25_subscribers", "p75_subscribers", "median_err", "median_views",
    "median_cpv", "median_campaign_price", "median_views_to_subs",
)
AS_OF = "1998-06-30"


def msql(needed: str, body: str) -> str:
    return d.with_views(d.MARKET_SQL, needed, body)


STATE = "v_niches v_channels v_lines v_snapshots latest scopes state"
ASSEMBLED = f"{STATE} metrics shares rates growths assembled"


def market(spark: SparkSession, sf_dir: str):
    return d.snapshots(spark, sf_dir), d.channels(spark, sf_dir), d.niches(spark, sf_dir)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps, chans, _ = market(spark, sf_dir)
    return mkt.channel_state(snaps, chans, every_scope=True)


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mkt.assembled_metrics(*market(spark, sf_dir), every_scope=True)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nsc.score_niches(assembled(spark, sf_dir))


def _round_sql(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


SNAPSHOT_OUT = """channel_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, created_at,
    subscribers, round(err, 6) AS err, predicted_views, round(cpv, 6) AS cpv, campaign_price"""


def _snapshot_out(df: DataFrame) -> DataFrame:
    return df.select(
        "channel_id", text("snapshot_date"), "created_at", "subscribers", rounded("err"),
        "predicted_views", rounded("cpv"), "campaign_price",
    )


@query("latest_snapshot", msql("v_lines v_snapshots latest", f"SELECT {SNAPSHOT_OUT} FROM latest"))
def latest_snapshot(spark, sf_dir):
    return _snapshot_out(mkt.latest_snapshot(d.snapshots(spark, sf_dir)))


@query(
    "latest_snapshot_as_of",
    msql("v_lines v_snapshots latest_then", f"SELECT {SNAPSHOT_OUT} FROM latest_then"),
)
def latest_snapshot_as_of(spark, sf_dir):
    return _snapshot_out(mkt.latest_snapshot(d.snapshots(spark, sf_dir), AS_OF))


@query(
    "latest_snapshots_at",
    msql(
        "v_lines v_snapshots",
        """SELECT CAST(as_of AS VARCHAR) AS as_of, channel_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, created_at, subscribers
            FROM (SELECT *, row_number() OVER (PARTITION BY as_of, channel_id
                ORDER BY snapshot_date DESC, created_at DESC, import_id DESC) AS rn
            FROM v_snapshots JOIN (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of FROM orders)
                ON snapshot_date <= as_of) WHERE rn = 1""",
    ),
)
def latest_snapshots_at(spark, sf_dir):
    """The market at the start of every quarter."""
    quarters = d.table(spark, sf_dir, "orders").select(F.date_trunc("quarter", "o_orderdate").cast("date").alias("as_of"))
    found = mkt.latest_snapshots_at(d.snapshots(spark, sf_dir), quarters)
    return found.select(text("as_of"), "channel_id", text("snapshot_date"), "created_at", "subscribers")


SKETCHED = ("subscribers", "err", "cpv")


@query(
    "niche_sketch_quantiles",
    msql(
        "v_channels v_lines v_snapshots",
        """, long AS (SELECT niche_id, unnest(['subscribers', 'err', 'cpv']) AS metric,
                unnest([CAST(subscribers AS DOUBLE), err, cpv]) AS value
            FROM v_snapshots JOIN v_channels USING (channel_id) WHERE niche_id IS NOT NULL)
        SELECT niche_id, metric, p, count(*) AS n, true AS within FROM long,
            (SELECT CAST(unnest([0.1, 0.5, 0.9]) AS DOUBLE) AS p) AS q
            WHERE value IS NOT NULL GROUP BY ALL""",
    ),
)
def niche_sketch_quantiles(spark, sf_dir):
    """Quantiles from merged sketches of all imports, and whether their exact ranks are as near as they should be."""
    path = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    snaps, chans, _ = market(spark, sf_dir)
    for part in (F.col("import_id") <= 1995, F.col("import_id") > 1995):
        sketches.store_sketches(sketches.niche_sketches(snaps.filter(part), chans, SKETCHED), path)
    probabilities = (0.1, 0.5, 0.9)
    merged = sketches.merged_quantiles(spark, path, probabilities)
    asked = merged.select("niche_id", "metric", "n", F.posexplode("quantiles").alias("i", "answer"))
    long = unpivot(snaps.join(chans.select("channel_id", "niche_id"), "channel_id"), ["niche_id"], SKETCHED)
    ranks = long.join(asked, ["niche_id", "metric"]).groupBy("niche_id", "metric", "n", "i").agg(
        F.count_if(F.col("value") < F.col("answer")).alias("below"), F.count_if(F.col("value") <= F.col("answer")).alias("upto")
    )
    p = F.element_at(F.array(*[F.lit(x) for x in probabilities]), F.col("i") + 1)
    slack = 2 * sketches.rank_error() + 1 / F.col("n")
    within = (F.col("below") / F.col("n") <= p + slack) & (F.col("upto") / F.col("n") >= p - slack)
    return ranks.select("niche_id", "metric", p.alias("p"), "n", within.alias("within"))


@query(
    "views_to_subscribers",
    msql(
        "v_lines v_snapshots",
        """SELECT channel_id, created_at, round(CASE WHEN subscribers > 0 AND predicted_views
            IS NOT NULL THEN CAST(predicted_views AS DOUBLE) / subscribers END, 9) AS ratio
            FROM v_snapshots""",
    ),
)
def views_to_subscribers(spark, sf_dir):
    ratio = mkt.views_to_subscribers(F.col("predicted_views"), F.col("subscribers"))
    return d.snapshots(spark, sf_dir).select(
        "channel_id", "created_at", F.round(ratio, 9).alias("ratio")
    )


COUNTS = ("channels_count", "subscribers_known", "total_subscribers")


@query(
    "niche_metrics",
    msql(
        f"{STATE} metrics",
        f"SELECT scope, niche_id, {', '.join(COUNTS)}, {_round_sql(METRIC_COLUMNS)} FROM metrics",
    ),
)
def niche_metrics(spark, sf_dir):
    found = mkt.niche_metrics(state(spark, sf_dir))
    return found.select("scope", "niche_id", *COUNTS, *map(rounded, METRIC_COLUMNS))


@query(
    "iqr_subscribers",
    msql(
        f"{STATE} metrics",
        """SELECT scope, niche_id, round(p75_subscribers - p25_subscribers, 6) AS iqr_subscribers
            FROM metrics""",
    ),
)
def iqr_subscribers(spark, sf_dir):
    return mkt.niche_metrics(state(spark, sf_dir)).select(
        "scope", "niche_id", rounded("iqr_subscribers")
    )


@query(
    "top_share",
    msql(
        f"{STATE} shares",
        "SELECT scope, niche_id, round(top_channel_share, 9) AS top_channel_share FROM shares",
    ),
)
def top_share(spark, sf_dir):
    return mkt.top_share(state(spark, sf_dir)).select(
        "scope", "niche_id", rounded("top_channel_share", 9)
    )


@query(
    "growth",
    msql(
        f"{STATE} rates growths",
        """SELECT scope, niche_id, round(median_growth_rate, 6) AS median_growth_rate,
            channels_with_history FROM growths""",
    ),
)
def growth(spark, sf_dir):
    snaps, chans, _ = market(spark, sf_dir)
    return mkt.growth(snaps, chans, every_scope=True).select(
        "scope", "niche_id", rounded("median_growth_rate"), "channels_with_history"
    )


@query(
    "platform_scope",
    msql(
        f"{STATE} metrics",
        f"""SELECT scope, niche_id, {', '.join(COUNTS)}, {_round_sql(METRIC_COLUMNS)}
            FROM metrics WHERE scope = 'MAX'""",
    ),
)
def platform_scope(spark, sf_dir):
    snaps, chans, _ = market(spark, sf_dir)
    found = mkt.niche_metrics(mkt.channel_state(snaps, chans, platform="MAX"))
    return found.select("scope", "niche_id", *COUNTS, *map(rounded, METRIC_COLUMNS))


@query(
    "dataset_summary",
    msql(
        "v_channels v_lines v_snapshots v_imports",
        """SELECT (SELECT count(*) FROM v_channels WHERE platform = 'TELEGRAM') AS channels,
        (SELECT count(*) FROM v_channels WHERE platform = 'TELEGRAM' AND niche_id IS NULL)
            AS channels_without_niche,
        (SELECT count(DISTINCT niche_id) FROM v_channels WHERE platform = 'TELEGRAM') AS niches,
        count(*) AS snapshots, count(DISTINCT snapshot_date) AS snapshot_dates,
        CAST(min(snapshot_date) AS VARCHAR) AS first_date,
        CAST(max(snapshot_date) AS VARCHAR) AS last_date,
        (SELECT count(*) FROM v_imports WHERE status IN ('SUCCESS', 'PARTIAL')) AS imports
        FROM v_snapshots WHERE channel_id IN
            (SELECT channel_id FROM v_channels WHERE platform = 'TELEGRAM')""",
    ),
)
def dataset_summary(spark, sf_dir):
    snaps, chans, _ = market(spark, sf_dir)
    found = mkt.dataset_summary(snaps, chans, d.imports(spark, sf_dir), platform="TELEGRAM")
    return found.withColumns(
        {c: F.col(c).cast("string") for c in ("first_date", "last_date")}
    )


@query(
    "platform_counts",
    msql("v_channels", "SELECT platform, count(*) AS channels FROM v_channels GROUP BY platform"),
)
def platform_counts(spark, sf_dir):
    return mkt.platform_counts(d.channels(spark, sf_dir))


@query(
    "completed_sources",
    msql(
        "v_imports v_sources",
        """SELECT DISTINCT name, kind FROM v_sources JOIN v_imports USING (source_id)
            WHERE status IN ('SUCCESS', 'PARTIAL')""",
    ),
)
def completed_sources(spark, sf_dir):
    return mkt.completed_sources(d.imports(spark, sf_dir), d.market_sources(spark, sf_dir))


ASSEMBLED_OUT = (*METRIC_COLUMNS, "iqr_subscribers", "top_channel_share", "median_growth_rate")


@query(
    "assembled_metrics",
    msql(
        ASSEMBLED,
        f"""SELECT scope, slug, name, {', '.join(COUNTS)}, {_round_sql(ASSEMBLED_OUT)},
            channels_with_history FROM assembled""",
    ),
)
def assembled_metrics(spark, sf_dir):
    return assembled(spark, sf_dir).select(
        "scope", "slug", "name", *COUNTS, *map(rounded, ASSEMBLED_OUT), "channels_with_history"
    )


@query(
    "market_overview",
    msql(
        ASSEMBLED,
        """SELECT scope, name, channels_count, round(median_subscribers, 6) AS median_subscribers,
            round(median_err, 6) AS median_err, round(top_channel_share, 6) AS top_channel_share
            FROM assembled""",
    ),
)
def market_overview(spark, sf_dir):
    shown = mkt.market_overview(assembled(spark, sf_dir))
    return shown.select(
        "scope", "name", "channels_count", rounded("median_subscribers"), rounded("median_err"),
        rounded("top_channel_share"),
    )


# ------------------------------------------------------------- niche score

_DATA = {key: metric for key, _, metric, _ in nsc.DATA_COMPONENTS}
_INVERTED = {key for key, _, _, invert in nsc.DATA_COMPONENTS if invert}
_RANKED_SQL = ",\n".join(
    f"""CASE WHEN {metric} IS NOT NULL THEN {'100 - ' if key in _INVERTED else ''}(
        (rank() OVER (PARTITION BY scope ORDER BY {metric} ASC NULLS LAST) - 1
        + 0.5::DOUBLE * count({metric}) OVER (PARTITION BY scope, {metric}))
        / count({metric}) OVER (PARTITION BY scope) * 100) END AS {key}"""
    for key, metric in _DATA.items()
)
_OVERRIDES = {"nation-3": {"production_cost": 80.0, "brand_safety": 20.0}, "nation-7": {"monetization_risk": 10.0}}


def _manual_sql(rating: str, invert: bool) -> str:
    cases = " ".join(
        f"WHEN '{slug}' THEN {values[rating]}" for slug, values in _OVERRIDES.items() if rating in values
    )
    raw = f"(CASE slug {cases} ELSE 50.0 END)::DOUBLE" if cases else "50.0::DOUBLE"
    return f"100 - {raw}" if invert else raw


_MANUAL_SQL = ", ".join(
    f"{_manual_sql(rating, invert)} AS {key}" for key, _, rating, invert in nsc.MANUAL_COMPONENTS
)
_TOP = " + ".join(f"coalesce({w}::DOUBLE * {k}, 0)" for k, w in nsc.WEIGHTS.items())
_BOTTOM = " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for k, w in nsc.WEIGHTS.items())
SCORE_VIEWS = {
    **d.MARKET_SQL,
    "eligible": "SELECT * FROM assembled WHERE channels_count >= 3",
    "ranked": f"SELECT scope, niche_id, slug, name, channels_count, {_RANKED_SQL}, {_MANUAL_SQL} FROM eligible",
    "scored": f"SELECT *, CAST(printf('%.2f', ({_TOP}) / ({_BOTTOM})) AS DOUBLE) AS score FROM ranked",
    "placed": """SELECT scope, niche_id, score, row_number() OVER (PARTITION BY scope
        ORDER BY score DESC, name, slug) AS rank FROM scored""",
}
SCORED = f"{ASSEMBLED} eligible ranked scored placed"
RULES = nsc.NicheScoreRules(overrides=_OVERRIDES)


def ssql(needed: str, body: str) -> str:
    return d.with_views(SCORE_VIEWS, needed, body)


@query(
    "percentile_rank",
    msql(
        ASSEMBLED,
        """SELECT scope, slug, round(CASE WHEN median_growth_rate IS NOT NULL THEN
            (rank() OVER (PARTITION BY scope ORDER BY median_growth_rate ASC NULLS LAST) - 1
            + 0.5::DOUBLE * count(median_growth_rate) OVER (PARTITION BY scope, median_growth_rate))
            / count(median_growth_rate) OVER (PARTITION BY scope) * 100 END, 6) AS percentile
            FROM assembled""",
    ),
)
def percentile_rank(spark, sf_dir):
    rank = nsc.percentile_rank(F.col("median_growth_rate"), ["scope"])
    return assembled(spark, sf_dir).select("scope", "slug", F.round(rank, 6).alias("percentile"))


@query(
    "niche_eligibility",
    msql(
        ASSEMBLED,
        "SELECT scope, slug, channels_count, channels_count < 3 AS insufficient_data FROM assembled",
    ),
)
def niche_eligibility(spark, sf_dir):
    fit, thin = nsc.split_eligible(assembled(spark, sf_dir), nsc.NicheScoreRules())
    flag = lambda df, value: df.select(
        "scope", "slug", "channels_count", F.lit(value).alias("insufficient_data")
    )
    return flag(fit, False).unionByName(flag(thin, True))


def _melt(keys, extra="") -> str:
    return " UNION ALL ".join(
        f"SELECT scope, slug, '{k}' AS key, round({k}, 6) AS value{extra} FROM ranked" for k in keys
    )


@query("data_components", ssql(f"{ASSEMBLED} eligible ranked", _melt(_DATA)))
def data_components(spark, sf_dir):
    return nsc.data_components(assembled(spark, sf_dir), RULES).select(
        "scope", "slug", "key", rounded("value")
    )


def _default_sql(rating: str) -> str:
    slugs = [f"'{s}'" for s, values in _OVERRIDES.items() if rating in values]
    return f"slug NOT IN ({', '.join(slugs)})" if slugs else "true"


@query(
    "manual_components",
    ssql(
        f"{ASSEMBLED} eligible ranked",
        " UNION ALL ".join(
            f"""SELECT scope, slug, '{key}' AS key, round({key}, 6) AS value,
                {_default_sql(rating)} AS is_default_rating FROM ranked"""
            for key, _, rating, _ in nsc.MANUAL_COMPONENTS
        ),
    ),
)
def manual_components(spark, sf_dir):
    return nsc.manual_components(assembled(spark, sf_dir), RULES).select(
        "scope", "slug", "key", rounded("value"), "is_default_rating"
    )


@query("weighted_score", ssql(SCORED, "SELECT scope, slug, score FROM scored"))
def weighted_score(spark, sf_dir):
    found = nsc.score_niches(assembled(spark, sf_dir), RULES)
    return found.filter(F.col("score").isNotNull()).select("scope", "slug", "score")


RANKING_SQL = ssql(
    SCORED,
    """SELECT a.scope, a.slug, a.name, a.channels_count, p.score, p.rank,
        a.channels_count < 3 AS insufficient_data
        FROM assembled a LEFT JOIN placed p USING (scope, niche_id)""",
)


@query("niche_ranking", RANKING_SQL)
def niche_ranking(spark, sf_dir):
    """Which niche ranks first on each platform and overall."""
    return nsc.score_niches(assembled(spark, sf_dir), RULES).select(
        "scope", "slug", "name", "channels_count", "score", F.col("rank").cast("bigint").alias("rank"),
        "insufficient_data",
    )


_LABELS = {key: label for key, label, _, _ in nsc.DATA_COMPONENTS + nsc.MANUAL_COMPONENTS}


@query(
    "score_breakdown",
    ssql(
        f"{ASSEMBLED} eligible ranked",
        " UNION ALL ".join(
            f"""SELECT scope, slug, '{k}' AS key, '{_LABELS[k]}' AS label,
                '{'data' if k in _DATA else 'manual'}' AS source, {w}::DOUBLE AS weight,
                round({k}, 2) AS value, {k} IS NOT NULL AS available FROM ranked"""
            for k, w in nsc.WEIGHTS.items()
        ),
    ),
)
def score_breakdown(spark, sf_dir):
    found = nsc.score_niches(assembled(spark, sf_dir), RULES)
    return found.select("scope", "slug", F.explode("components").alias("key", "c")).select(
        "scope", "slug", "key", "c.label", "c.source", "c.weight",
        F.round("c.value", 2).alias("value"), "c.available",
    )


RUN_SQL = """SELECT scope, count(score) AS niches_scored, count(*) - count(score) AS niches_skipped,
    count(score) BETWEEN 1 AND 4 AS low_confidence
    FROM assembled LEFT JOIN placed USING (scope, niche_id) GROUP BY scope"""


@query("low_confidence", ssql(SCORED, RUN_SQL))
def low_confidence(spark, sf_dir):
    return nsc.run_summary(nsc.score_niches(assembled(spark, sf_dir), RULES), RULES)


CREATED_AT = "2024-02-01 00:00:00"


def _run(spark, sf_dir):
    snaps, chans, _ = market(spark, sf_dir)
    found = nsc.score_niches(assembled(spark, sf_dir), RULES)
    facts = mkt.dataset_summary(snaps, chans, d.imports(spark, sf_dir))
    return nsc.persistable_run(found, facts, CREATED_AT, RULES)


@query(
    "persisted_run",
    ssql(
        SCORED,
        f"""SELECT sha256('niche_score_v1:' || scope || ':{CREATED_AT}') AS run_id,
            nullif(scope, 'ALL') AS platform, niches_scored, niches_skipped, low_confidence
            FROM ({RUN_SQL})""",
    ),
)
def persisted_run(spark, sf_dir):
    runs, _ = _run(spark, sf_dir)
    return runs.select("run_id", "platform", "niches_scored", "niches_skipped", "low_confidence")


@query(
    "latest_run",
    ssql(
        SCORED,
        f"""SELECT sha256('niche_score_v1:' || scope || ':{CREATED_AT}') AS run_id, niches_scored
            FROM ({RUN_SQL}) WHERE scope = 'ALL'""",
    ),
)
def latest_run(spark, sf_dir):
    runs, _ = _run(spark, sf_dir)
    return nsc.latest_run(runs).select("run_id", "niches_scored")


@query(
    "scores_for_run",
    ssql(
        SCORED,
        """SELECT a.slug, a.name, p.rank, p.score FROM assembled a
            LEFT JOIN placed p USING (scope, niche_id) WHERE a.scope = 'MAX'""",
    ),
)
def scores_for_run(spark, sf_dir):
    runs, rows = _run(spark, sf_dir)
    found = nsc.scores_for_run(rows, d.niches(spark, sf_dir), nsc.latest_run(runs, platform="MAX"))
    return found.select(
        "slug", "name", F.col("rank").cast("bigint").alias("rank"), rounded("score", 2)
    )


@query(
    "report_caveats",
    ssql(
        SCORED,
        " UNION ALL ".join(
            f"""SELECT scope, 'unavailable_component' AS caveat, '{k}' AS detail, count(*) AS niches
                FROM ranked WHERE {k} IS NULL GROUP BY scope"""
            for k in nsc.WEIGHTS
        )
        + f""" UNION ALL SELECT scope, 'only_default_ratings', '', count(*) FROM ranked
            WHERE slug NOT IN ({', '.join(f"'{s}'" for s in _OVERRIDES)}) GROUP BY scope
        UNION ALL SELECT scope, 'excluded_thin_niches', '', count(*) FROM assembled
            WHERE channels_count < 3 GROUP BY scope
        UNION ALL SELECT scope, 'low_confidence', '', niches_scored FROM ({RUN_SQL})
            WHERE low_confidence""",
    ),
)
def report_caveats(spark, sf_dir):
    found = nsc.score_niches(assembled(spark, sf_dir), RULES)
    return nsc.report_caveats(found, RULES).select("scope", "caveat", "detail", "niches")


RANKING_SQL = ssql(
        SCORED,
        f"""SELECT p.rank, a.slug, a.name, printf('%.2f', p.score) AS score,
            a.channels_count, a.channels_count < 3 AS insufficient_data,
            round(a.median_subscribers, 6) AS median_subscribers,
            round(a.top_channel_share, 6) AS top_channel_share,
            printf('%.2f', r.market_size) AS market_size,
            printf('%.2f', r.low_production_cost) AS low_production_cost
            FROM assembled a LEFT JOIN placed p USING (scope, niche_id)
            LEFT JOIN ranked r USING (scope, niche_id) WHERE a.scope = 'ALL'""",
    )


@query("ranking_table", RANKING_SQL)
def ranking_table(spark, sf_dir):
    found = nsc.score_niches(
        mkt.assembled_metrics(*market(spark, sf_dir)), RULES
    )
    return nsc.ranking_table(found, F.lit("run")).select(
        F.col("rank").cast("bigint").alias("rank"), "slug", "name", "score", "channels_count",
        "insufficient_data", rounded("median_subscribers"), rounded("top_channel_share"),
        "market_size", "low_production_cost",
    )


@query("ranking_csv", RANKING_SQL)
def ranking_csv(spark, sf_dir):
    """The same report written as CSV to the shared folder and read back."""
    report = ranking_table(spark, sf_dir)
    path = f"{shared_folder(spark)}/ranking-{uuid.uuid4().hex}"
    sinks.write_ranking_csv(report, path)
    return spark.read.schema(report.schema).csv(path, header=True)



@query(
    "compare_platforms",
    ssql(
        SCORED,
        """, sides AS (SELECT a.scope, a.slug, a.name, a.channels_count, p.score, p.rank
            FROM assembled a LEFT JOIN placed p USING (scope, niche_id))
        SELECT coalesce(t.slug, m.slug) AS slug, coalesce(t.name, m.name) AS name,
            t.score AS score_telegram, t.rank AS rank_telegram,
            coalesce(t.channels_count, 0) AS channels_telegram,
            m.score AS score_max, m.rank AS rank_max,
            coalesce(m.channels_count, 0) AS channels_max,
            t.score IS NOT NULL AND m.score IS NOT NULL AS on_both,
            CASE WHEN t.score IS NOT NULL AND m.score IS NOT NULL THEN least(t.score, m.score) END
                AS weakest_score,
            round(abs(t.score - m.score), 2) AS gap,
            coalesce(abs(t.score - m.score) >= 15, false) AS is_asymmetric
            FROM (SELECT * FROM sides WHERE scope = 'TELEGRAM') t
            FULL JOIN (SELECT * FROM sides WHERE scope = 'MAX') m ON t.slug = m.slug""",
    ),
)
def compare_platforms(spark, sf_dir):
    found = nsc.compare_platforms(nsc.score_niches(assembled(spark, sf_dir), RULES))
    return found.withColumns(
        {
            "rank_telegram": F.col("rank_telegram").cast("bigint"),
            "rank_max": F.col("rank_max").cast("bigint"),
            "gap": F.round("gap", 2),
        }
    )


# ------------------------------------------------------------- competitors

PROFILE = "v_niches v_channels v_lines v_snapshots latest profile"
STANDING = f"{PROFILE} standing"


def profiles(spark, sf_dir, **scope) -> DataFrame:
    return cmp.profiles(*market(spark, sf_dir), **scope)


STANDING_OUT = """channel_id, channel_name, channel_url, platform, niche_slug, subscribers,
    round(subscribers_pct, 6) AS subscribers_pct, round(err_pct, 6) AS err_pct,
    round(views_pct, 6) AS views_pct"""


def _standing_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "channel_id", "channel_name", "channel_url", "platform", "niche_slug", "subscribers",
        rounded("subscribers_pct"), rounded("err_pct"), rounded("views_pct"), *more,
    )


@query("enriched_profiles", msql(STANDING, f"SELECT {STANDING_OUT} FROM standing"))
def enriched_profiles(spark, sf_dir):
    return _standing_out(cmp.enriched(profiles(spark, sf_dir)))


BENCH = {
    "subscribers": ((0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90")),
    "err": ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")),
    "views": ((0.5, "p50"), (0.9, "p90")),
    "cpv": ((0.5, "p50"),),
    "price": ((0.5, "p50"),),
}
_SOURCE = {"views": "predicted_views", "price": "campaign_price"}
BENCH_COLUMNS = [f"{m}_{q}" for m, qs in BENCH.items() for _, q in qs]
_BENCH_SQL = ", ".join(
    f"round(quantile_cont({_SOURCE.get(m, m)}, {p}), 6) AS {m}_{q}"
    for m, qs in BENCH.items()
    for p, q in qs
)
_HEAD_SQL = """SELECT scope, niche_slug, CAST(sum(CASE WHEN p <= 10 THEN subscribers END) AS DOUBLE)
    / nullif(sum(subscribers), 0) AS head_share, count(*) AS ranked_channels
    FROM (SELECT *, row_number() OVER (PARTITION BY scope, niche_slug
        ORDER BY subscribers DESC, channel_id) AS p FROM rows WHERE subscribers IS NOT NULL)
    GROUP BY scope, niche_slug"""
BENCH_VIEWS = {
    **d.MARKET_SQL,
    "rows": """SELECT *, 'ALL' AS scope FROM profile WHERE niche_slug IS NOT NULL
        UNION ALL SELECT *, platform FROM profile WHERE niche_slug IS NOT NULL""",
    "heads": _HEAD_SQL,
}


@query(
    "niche_benchmarks",
    d.with_views(
        BENCH_VIEWS,
        f"{PROFILE} rows heads",
        f"""SELECT scope, niche_slug, max(niche_name) AS niche_name, count(*) AS channels_count,
            max(subscribers) AS subscribers_max, CAST(sum(subscribers) AS BIGINT)
            AS subscribers_total, CAST(max(snapshot_date) AS VARCHAR) AS snapshot_date,
            {_BENCH_SQL}, round(max(head_share), 9) AS head_share
            FROM rows LEFT JOIN heads USING (scope, niche_slug) GROUP BY scope, niche_slug""",
    ),
)
def niche_benchmarks(spark, sf_dir):
    found = cmp.niche_benchmarks(profiles(spark, sf_dir), every_scope=True)
    return found.select(
        "scope", "niche_slug", "niche_name", "channels_count", "subscribers_max",
        "subscribers_total", text("snapshot_date"), *map(rounded, BENCH_COLUMNS),
        rounded("head_share", 9),
    )


@query(
    "head_share",
    d.with_views(
        BENCH_VIEWS,
        f"{PROFILE} rows heads",
        "SELECT scope, niche_slug, round(head_share, 9) AS head_share, ranked_channels FROM heads",
    ),
)
def head_share(spark, sf_dir):
    rows = mkt.scoped(
        profiles(spark, sf_dir).filter(F.col("niche_slug").isNotNull()), every_scope=True
    )
    return cmp.head_share(rows).select(
        "scope", "niche_slug", rounded("head_share", 9), "ranked_channels"
    )


def _board_sql(metric: str, limit: int, where: str = "true") -> str:
    return f"""SELECT niche_slug, channel_id, position, subscribers, round({metric}, 6) AS metric
        FROM (SELECT *, row_number() OVER (PARTITION BY niche_slug ORDER BY {metric} DESC, channel_id)
            AS position FROM standing WHERE niche_slug IS NOT NULL AND {metric} IS NOT NULL
            AND {where}) WHERE position <= {limit}"""


@query("niche_leaders", msql(STANDING, _board_sql("err", 10, "subscribers >= 150000")))
def niche_leaders(spark, sf_dir):
    rows = profiles(spark, sf_dir).filter(F.col("niche_slug").isNotNull())
    return cmp.leaders(rows, "err", 10, min_subscribers=150000).select(
        "niche_slug", "channel_id", F.col("position").cast("bigint").alias("position"),
        "subscribers", F.round("err", 6).alias("metric"),
    )


@query("channel_profile", msql(STANDING, f"SELECT {STANDING_OUT} FROM standing WHERE channel_id = 77"))
def channel_profile(spark, sf_dir):
    return _standing_out(cmp.channel_profile(cmp.enriched(profiles(spark, sf_dir)), 77))


@query(
    "search_channels",
    msql(
        STANDING,
        f"""SELECT {STANDING_OUT} FROM standing WHERE channel_name ILIKE '%r#0000000_3%'
            OR channel_url ILIKE '%r#0000000_3%' ORDER BY subscribers DESC NULLS LAST, channel_id
            LIMIT 20""",
    ),
)
def search_channels(spark, sf_dir):
    return _standing_out(cmp.search_channels(cmp.enriched(profiles(spark, sf_dir)), "R#0000000_3"))


@query(
    "search_channels_indexed",
    msql(
        STANDING,
        f"""SELECT {STANDING_OUT} FROM standing WHERE channel_name ILIKE '%r#0000000_3%'
            OR channel_url ILIKE '%r#0000000_3%'""",
    ),
)
def search_channels_indexed(spark, sf_dir):
    """The same search through posting lists over all channels; every hit, not the first twenty."""
    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    texts = ["channel_name", "channel_url"]
    textindex.write_search_index(d.channels(spark, sf_dir).select("channel_id", *texts), path, "channel_id", texts)
    found = textindex.search(spark, path, "channel_id", texts, "R#0000000_3").select("channel_id")
    return _standing_out(cmp.enriched(profiles(spark, sf_dir)).join(found, "channel_id", "left_semi"))


@query(
    "watchlist",
    msql(
        f"{STANDING} v_watched",
        f"SELECT {STANDING_OUT}, notes AS watch_notes FROM standing JOIN v_watched USING (channel_id)",
    ),
)
def watchlist(spark, sf_dir):
    found = cmp.watchlist(cmp.enriched(profiles(spark, sf_dir)), d.watched(spark, sf_dir))
    return _standing_out(found, "watch_notes")


def _watch_requests(spark, sf_dir) -> DataFrame:
    return d.table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_acctbal > 9000 THEN -1 - c_custkey ELSE c_custkey END AS channel_id",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN concat('note ', c_name) END AS notes",
        "timestamp '2024-02-01 00:00:00' AS created_at",
        "c_acctbal",
    ).filter("c_acctbal < 500 OR c_acctbal > 8000").drop("c_acctbal")


@query(
    "watch",
    msql(
        "v_watched",
        """, requests AS (SELECT c_custkey AS channel_id, CASE WHEN c_mktsegment = 'BUILDING'
            THEN 'note ' || c_name END AS notes FROM customer
            WHERE c_acctbal < 500 OR (c_acctbal > 8000 AND c_acctbal <= 9000))
        SELECT channel_id, coalesce(r.notes, w.notes) AS notes, CASE WHEN w.channel_id IS NOT NULL
            THEN '2024-01-01' ELSE '2024-02-01' END AS watched_since
            FROM v_watched w FULL JOIN requests r USING (channel_id)""",
    ),
)
def watch(spark, sf_dir):
    found = cmp.watch(
        d.watched(spark, sf_dir), _watch_requests(spark, sf_dir), d.channels(spark, sf_dir)
    )
    return found.select(
        "channel_id", "notes", F.date_format("created_at", "yyyy-MM-dd").alias("watched_since")
    )


@query(
    "unwatch",
    msql(
        "v_watched v_channels",
        """SELECT channel_id, notes FROM v_watched WHERE channel_id NOT IN
            (SELECT channel_id FROM v_channels WHERE platform = 'MAX')""",
    ),
)
def unwatch(spark, sf_dir):
    gone = d.channels(spark, sf_dir).filter("platform = 'MAX'")
    return cmp.unwatch(d.watched(spark, sf_dir), gone).select("channel_id", "notes")


def _dossier_part(board: str, order: str, where: str, limit: str) -> str:
    return f"""SELECT '{board}' AS board, niche_slug, channel_id, row_number() OVER (
        PARTITION BY niche_slug ORDER BY {order}) AS position, subscribers,
        round(subscribers_pct, 6) AS subscribers_pct FROM floored WHERE {where}
        QUALIFY position <= {limit}"""


@query(
    "niche_dossier",
    msql(
        f"{STANDING} v_watched",
        """, floored AS (SELECT s.*, floor(m) AS engagement_floor FROM standing s JOIN
            (SELECT niche_slug, quantile_cont(subscribers, 0.5) AS m FROM profile
             GROUP BY niche_slug) USING (niche_slug))
        """
        + " UNION ALL ".join(
            (
                _dossier_part("subscribers", "subscribers DESC, channel_id", "subscribers IS NOT NULL", "10"),
                _dossier_part(
                    "engagement",
                    "err DESC, channel_id",
                    "err IS NOT NULL AND (engagement_floor IS NULL OR subscribers >= engagement_floor)",
                    "10",
                ),
                _dossier_part(
                    "price", "campaign_price DESC, channel_id", "campaign_price IS NOT NULL", "10"
                ),
                _dossier_part(
                    "watched",
                    "subscribers DESC NULLS LAST, channel_id",
                    "channel_id IN (SELECT channel_id FROM v_watched)",
                    "1000000000",
                ),
            )
        ),
    ),
)
def niche_dossier(spark, sf_dir):
    found = cmp.niche_dossier(profiles(spark, sf_dir), d.watched(spark, sf_dir))
    return found.select(
        "board", "niche_slug", "channel_id", F.col("position").cast("bigint").alias("position"),
        "subscribers", rounded("subscribers_pct"),
    )


@query(
    "profile_ratio",
    msql(PROFILE, "SELECT channel_id, round(views_to_subs, 9) AS views_to_subs FROM profile"),
)
def profile_ratio(spark, sf_dir):
    return profiles(spark, sf_dir).select("channel_id", rounded("views_to_subs", 9))
