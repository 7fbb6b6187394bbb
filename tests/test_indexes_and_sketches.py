"""Posting lists, term tables, dates all at once, merged sketches."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from nichelens.functions.lexicon import Lexicon, relevance
from nichelens.operators import market as mkt
from nichelens.operators import sketches, textindex


@pytest.fixture(scope="module")
def channels(spark, tmp_path_factory):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abAB_%é .") for _ in range(r.randint(0, 9))), f"https://t.me/{r.choice('xyz')}{i}") for i in range(400)]
    rows += [(900, None, "https://t.me/none"), (901, "İstanbul ΑΒΓ", None), (902, None, None), (903, "back\\slash", "u")]
    df = spark.createDataFrame(rows, "channel_id long, channel_name string, channel_url string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    textindex.write_search_index(df, path, "channel_id", ["channel_name", "channel_url"], buckets=8)
    return df, path


@pytest.mark.parametrize("query", ["t.me/x1", "ABa", "aba", "a_a b", "x%9", "zzz", "me/none", "ab", "", "%", "αβγ", "k\\\\s", "é", "HTTPS", "https://t.me/y3"])
def test_search_by_postings_equals_a_scan(spark, channels, query):
    df, path = channels
    got = textindex.search(spark, path, "channel_id", ["channel_name", "channel_url"], query, buckets=8)
    pattern = f"%{query}%"
    want = df.filter(F.col("channel_name").ilike(pattern) | F.col("channel_url").ilike(pattern))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_a_search_reads_few_posting_files(spark, channels):
    _, path = channels
    files = len(spark.read.parquet(f"{path}/postings").inputFiles())
    wanted = ["none"[:3], "e/n"]
    read = textindex._of_grams(spark, f"{path}/postings", wanted, 8)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan and files >= 8
    assert {r["gram"] for r in read.select("gram").distinct().collect()} == set(wanted)


def test_term_tables_equal_the_expression(spark):
    r = random.Random(5)
    words = ["как", "guide", "step-by-step", "ai", "x", "раунд финансирован", "how to", "aaaa", "aa", "é"]
    lexicon = Lexicon(positive={w: 3.5 * i + 1 for i, w in enumerate(words)}, negative={"aa": 7.0, "не": 2.0, "guide ai": 50.0})
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(120)] + [(500, None), (501, ""), (502, "aaaaaaaa")]
    df = spark.createDataFrame(texts, "item_id int, body string")
    terms = textindex.term_table(spark, {"positive": lexicon.positive, "negative": lexicon.negative})
    got = textindex.relevance_by_table(df, terms, "item_id", "body", lexicon)
    want = df.filter("body IS NOT NULL").select("item_id", relevance(F.col("body"), lexicon).alias("r")).select("item_id", "r.*")
    rows = {r["item_id"]: tuple(r)[1:] for r in got.collect()}
    assert {k: v for k, v in rows.items() if k != 500} == {r["item_id"]: tuple(r)[1:] for r in want.collect()}
    assert rows[500] == (40.0, [], [])


def test_many_terms_make_no_larger_plan(spark):
    df = spark.createDataFrame([(1, "term 99999 here")], "item_id int, body string")
    plans = []
    for n in (10, 100_000):
        terms = spark.range(n).selectExpr("'positive' AS list", "cast(id AS int) AS position", "concat('term ', id) AS term", "1.0D AS weight")
        found = textindex.matched_terms(df, terms, "item_id", "body")
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(plans[1] - plans[0]) < 500
    assert {t for r in found.collect() for t in r["terms"]} == {f"term {'99999'[:k]}" for k in range(1, 6)}


def test_dates_at_once_equal_one_by_one(spark):
    r = random.Random(6)
    day = date(2024, 1, 1)
    rows = [(r.choice([1, 1, 1, 2, 3]), r.randrange(4), day + timedelta(r.randrange(60)), i, r.randrange(99)) for i in range(200)]
    df = spark.createDataFrame(rows, "channel_id long, import_id int, snapshot_date date, created_at long, subscribers int")
    dates = ["2023-12-31", "2024-01-01", "2024-01-20", "2024-02-10", "2024-02-10", "2024-03-01", "2025-01-01"]
    wanted = spark.createDataFrame([(x,) for x in dates] + [(None,)], "as_of string")
    got = {(str(r["as_of"]), *tuple(r)[1:]) for r in mkt.latest_snapshots_at(df, wanted).collect()}
    want = {(x, *tuple(r)) for x in set(dates) for r in mkt.latest_snapshot(df, x).collect()}
    assert got == want
    assert mkt.latest_snapshots_at(df, wanted.limit(0)).count() == 0 and mkt.latest_snapshots_at(df.limit(0), wanted).count() == 0


def test_sketches_merge_within_their_error(spark, tmp_path):
    r = random.Random(7)
    rows = [(i % 50, 2020 + i % 4, r.lognormvariate(8, 2) if i % 11 else None) for i in range(40_000)]
    snaps = spark.createDataFrame(rows, "channel_id long, import_id int, subscribers double")
    chans = spark.createDataFrame([(i, f"n{i % 2}" if i < 48 else None) for i in range(50)], "channel_id long, niche_id string")
    path = str(tmp_path / "s")
    for year in (2020, 2021, 2022):
        sketches.store_sketches(sketches.niche_sketches(snaps.filter(F.col("import_id") == year), chans, ["subscribers"]), path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    sketches.store_sketches(sketches.niche_sketches(snaps.filter("import_id = 2023"), chans, ["subscribers"]), path)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    assert before.items() <= after.items() and {p.parent.name for p in after.keys() - before.keys()} == {"import_id=2023"}
    for chosen in (None, [2020, 2023]):
        for row in sketches.merged_quantiles(spark, path, (0.05, 0.5, 0.95), chosen).collect():
            values = sorted(v for c, y, v in rows if v is not None and c < 48 and f"n{c % 2}" == row["niche_id"] and (not chosen or y in chosen))
            assert row["n"] == len(values)
            for p, answer in zip((0.05, 0.5, 0.95), row["quantiles"], strict=True):
                rank = sum(v <= answer for v in values) / len(values)
                assert abs(rank - p) <= 2 * sketches.rank_error()
