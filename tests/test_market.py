import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichelens.functions.stats import cumulative_counts, quantiles
from nichelens.operators import competitors as cmp
from nichelens.operators import market as mkt
from nichelens.operators import niches as nsc

F2 = [
    ("AI Tools", "ai", 10000, 0.25, 3000, 1.50, 20000.0),
    ("Neuro News", "ai", 20000, 0.22, 5000, 1.40, 30000.0),
    ("Prompt Lab", "ai", 30000, 0.20, 7000, 1.30, 40000.0),
    ("Career IT", "career", 5000, 0.12, 900, 0.60, 6000.0),
    ("Job Hunt", "career", 6000, 0.11, 1000, 0.55, 7000.0),
    ("Dev Path", "career", 7000, 0.10, 1100, 0.50, 8000.0),
]


def test_quantiles_equal_numpy_under_skew(spark):
    rng = random.Random(1)
    rows = []
    for group, size in (("hot", 4000), ("one", 1), ("two", 2), ("mixed", 50)):
        for _ in range(size):
            value = rng.choice([0.0, -3.5, 7.0]) if rng.random() < 0.3 else rng.uniform(-1e6, 1e6)
            rows.append((group, value))
    df = spark.createDataFrame(rows, "g string, value double")
    got = quantiles(df, ["g"], (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)).collect()
    for r in got:
        values = [v for g, v in rows if g == r["g"]]
        want = np.quantile(values, (0.0, 0.1, 0.25, 0.5, 0.9, 1.0))
        assert np.allclose([r[f"q{i}"] for i in range(6)], want)
    for r in cumulative_counts(df, ["g"]).filter("g = 'mixed'").collect():
        values = [v for g, v in rows if g == "mixed"]
        assert r["below"] == sum(v < r["value"] for v in values)
        assert r["upto"] == sum(v <= r["value"] for v in values)


def tables(spark, dates=("2026-09-01",), factor=1.5):
    snaps, chans = [], []
    for i, (name, niche, subs, err, views, cpv, price) in enumerate(F2):
        chans.append((i, name, f"https://t.me/{i}", "TELEGRAM", niche))
        for n, day in enumerate(dates):
            grown = int(subs * factor**n)
            snaps.append((i, n, date.fromisoformat(day), n, grown, err, views, cpv, price, "RUB"))
    s = spark.createDataFrame(
        snaps,
        "channel_id int, import_id int, snapshot_date date, created_at int, subscribers bigint, err double, "
        "predicted_views bigint, cpv double, campaign_price double, currency string",
    )
    c = spark.createDataFrame(
        chans, "channel_id int, channel_name string, channel_url string, platform string, niche_id string"
    )
    n = spark.createDataFrame([("ai", "ai", "AI"), ("career", "career", "Career")], "niche_id string, slug string, name string")
    return s, c, n


def test_one_date_has_no_growth_and_whole_niche_no_share(spark):
    rows = {r["slug"]: r for r in mkt.assembled_metrics(*tables(spark)).collect()}
    ai = rows["ai"]
    assert ai["median_subscribers"] == 20000 and ai["channels_count"] == 3
    assert ai["top_channel_share"] is None and ai["median_growth_rate"] is None
    assert ai["channels_with_history"] == 0 and ai["iqr_subscribers"] == 10000


def test_two_dates_grow_and_as_of_looks_back(spark):
    data = tables(spark, ("2026-09-01", "2026-10-01"))
    now = {r["slug"]: r for r in mkt.assembled_metrics(*data).collect()}
    assert now["ai"]["median_growth_rate"] == pytest.approx(0.5)
    assert now["ai"]["median_subscribers"] == 30000
    then = {r["slug"]: r for r in mkt.assembled_metrics(*data, as_of="2026-09-15").collect()}
    assert then["ai"]["median_subscribers"] == 20000 and then["ai"]["median_growth_rate"] is None


def metrics(spark, rows):
    names = [m for _, _, m, _ in nsc.DATA_COMPONENTS if m != "channels_count"]
    schema = "scope string, niche_id string, slug string, name string, channels_count bigint, " + ", ".join(
        f"{n} double" for n in names
    )
    full = [("ALL", r["slug"], r["slug"], r["slug"], r.get("n", 5), *[r.get(n) for n in names]) for r in rows]
    return spark.createDataFrame(full, schema)


def scored(spark, rows, **rules):
    got = nsc.score_niches(metrics(spark, rows), nsc.NicheScoreRules(**rules)).collect()
    return {r["slug"]: r for r in got}


def test_percentile_rank_ties_and_singletons(spark):
    got = scored(
        spark,
        [{"slug": s, "median_err": v} for s, v in (("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None))],
        weights={"engagement": 1.0},
    )
    assert [got[s]["score"] for s in "abcd"] == [16.67, 66.67, 66.67, None]
    assert [got[s]["rank"] for s in "abcd"] == [3, 1, 2, None]
    alone = scored(spark, [{"slug": "a", "median_err": 7.0}], weights={"engagement": 1.0})
    assert alone["a"]["score"] == 50.0


def test_thin_niches_stay_out_of_the_scale(spark):
    rows = [{"slug": "a", "median_err": 1.0}, {"slug": "b", "median_err": 2.0}, {"slug": "t", "median_err": 9.0, "n": 2}]
    got = scored(spark, rows, weights={"engagement": 1.0})
    assert (got["a"]["score"], got["b"]["score"]) == (25.0, 75.0)
    assert got["t"]["insufficient_data"] and got["t"]["score"] is None and got["t"]["components"] is None


def test_missing_components_hand_over_their_weight(spark):
    rows = [{"slug": "a", "median_err": 1.0, "median_cpv": 5.0}, {"slug": "b", "median_err": 2.0}]
    got = scored(spark, rows, weights={"engagement": 0.5, "audience_value": 0.5})
    assert got["a"]["score"] == 37.5 and got["b"]["score"] == 75.0
    assert got["b"]["components"]["audience_value"]["note"] == "no data in the current dataset"


def test_low_competition_and_manual_ratings_invert(spark):
    rows = [{"slug": "a", "top_channel_share": 0.9}, {"slug": "b", "top_channel_share": 0.1}]
    got = scored(
        spark,
        rows,
        weights={"low_competition": 0.5, "low_production_cost": 0.5},
        overrides={"a": {"production_cost": 90.0}},
    )
    a = got["a"]["components"]
    assert a["low_competition"]["value"] == 25.0 and a["low_production_cost"]["value"] == 10.0
    assert not a["low_production_cost"]["is_default_rating"]
    assert got["b"]["components"]["low_production_cost"]["is_default_rating"]


def test_cross_platform_order_treats_zero_as_missing(spark):
    rows = [
        ("TELEGRAM", "zero", 0.0), ("MAX", "zero", 50.0), ("TELEGRAM", "both", 40.0), ("MAX", "both", 60.0),
        ("TELEGRAM", "lone", 99.0),
    ]
    df = spark.createDataFrame(rows, "scope string, slug string, score double").selectExpr(
        "*", "slug AS name", "1 AS rank", "5L AS channels_count"
    )
    got = nsc.compare_platforms(df).collect()
    assert [r["slug"] for r in got] == ["both", "zero", "lone"]
    assert got[0]["weakest_score"] == 40 and got[0]["gap"] == 20 and got[0]["is_asymmetric"]
    assert got[2]["gap"] is None and not got[2]["is_asymmetric"]


F3 = [
    ("tech", "TELEGRAM", 100000, 0.10), ("tech", "TELEGRAM", 60000, 0.20), ("tech", "TELEGRAM", 30000, 0.30),
    ("tech", "TELEGRAM", 20000, 0.15), ("tech", "TELEGRAM", 10000, 0.40), ("tech", "TELEGRAM", 2000, 0.95),
    ("tech", "MAX", 15000, 0.50), ("tech", "MAX", 9000, 0.20), ("tech", "MAX", 5000, 0.10),
    ("food", "TELEGRAM", 700, None), ("food", "TELEGRAM", None, 0.3), (None, "MAX", 1, 0.1),
]


@pytest.fixture(scope="module")
def base(spark):
    s = spark.createDataFrame(
        [(i, 1, date(2026, 9, 1), 1, subs, err, 10, 1.0, 100.0, "RUB") for i, (_, _, subs, err) in enumerate(F3)],
        "channel_id int, import_id int, snapshot_date date, created_at int, subscribers bigint, err double, "
        "predicted_views bigint, cpv double, campaign_price double, currency string",
    )
    c = spark.createDataFrame(
        [(i, f"Channel {i}", f"https://t.me/c{i}", p, n) for i, (n, p, _, _) in enumerate(F3)],
        "channel_id int, channel_name string, channel_url string, platform string, niche_id string",
    )
    n = spark.createDataFrame([("tech", "tech", "Tech"), ("food", "food", "Food")], "niche_id string, slug string, name string")
    return cmp.profiles(s, c, n)


def test_benchmarks_and_boards(spark, base):
    tech = cmp.niche_benchmarks(base).filter("niche_slug = 'tech'").first()
    assert (tech["channels_count"], tech["subscribers_p50"], tech["subscribers_max"]) == (9, 15000, 100000)
    assert tech["head_share"] == 1.0
    watched = spark.createDataFrame([(5,)], "channel_id int")
    rows = cmp.niche_dossier(base, watched, limit=3).filter("niche_slug = 'tech'").collect()
    board = lambda name: [r["channel_id"] for r in sorted(rows, key=lambda r: r["position"]) if r["board"] == name]
    assert board("subscribers") == [0, 1, 2]
    assert board("engagement")[0] == 6 and 5 not in board("engagement")
    assert board("watched") == [5]


def test_standing_is_per_platform_and_unknown_stands_last(base):
    got = {r["channel_id"]: r for r in cmp.enriched(base).collect()}
    assert got[0]["subscribers_pct"] == 100 and got[6]["subscribers_pct"] == 100
    assert got[5]["subscribers_pct"] == pytest.approx(100 / 6)
    assert got[9]["subscribers_pct"] == 50 and got[10]["subscribers_pct"] == 100
    assert got[9]["err_pct"] == 100 and got[11]["niche_slug"] is None


def test_search_and_watchlist_maintenance(spark, base):
    found = cmp.search_channels(cmp.enriched(base), "CHANNEL 1", limit=2)
    assert [r["channel_id"] for r in found.collect()] == [1, 11]
    watched = spark.createDataFrame([(1, "old", "t1")], "channel_id int, notes string, created_at string")
    requests = spark.createDataFrame(
        [(1, None, "t2"), (2, "new", "t2"), (999, "ghost", "t2")], "channel_id int, notes string, created_at string"
    )
    channels = spark.range(10).selectExpr("cast(id AS int) AS channel_id")
    got = {r["channel_id"]: (r["notes"], r["created_at"]) for r in cmp.watch(watched, requests, channels).collect()}
    assert got == {1: ("old", "t1"), 2: ("new", "t2")}
    assert cmp.unwatch(watched, channels).count() == 0
    with pytest.raises(ValueError, match="leader metric"):
        cmp.leaders(base, "channel_name")


def test_latest_run_scope(spark):
    runs = spark.createDataFrame(
        [("r1", None, 1), ("r2", "MAX", 3), ("r3", None, 2)], "run_id string, platform string, created_at int"
    ).withColumn("score_version", F.lit("v1"))
    assert nsc.latest_run(runs).first()["run_id"] == "r3"
    assert nsc.latest_run(runs, platform="MAX").first()["run_id"] == "r2"
    assert nsc.latest_run(runs, any_scope=True).first()["run_id"] == "r2"
