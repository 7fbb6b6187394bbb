import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nichelens.functions.lexicon import Lexicon, practical_value, relevance
from nichelens.functions.weighted import round_percent
from nichelens.operators import drafts as cnt
from nichelens.operators import ledger as led
from nichelens.operators import research as res
from nichelens.operators import slots as slt
from nichelens.operators import topics as sco

NOW = "2026-09-10 12:00:00"


def test_round_percent_equals_python(spark):
    rng = random.Random(1)
    values = [rng.uniform(0, 100) for _ in range(500)] + [i / 1000 for i in range(0, 100000, 37)]
    values += [57.125, 57.115, 2.675, 0.125, 42.004999999999995, 0.0, 100.0, 99.995, 1.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", round_percent(F.col("v")).alias("r")).collect()
    assert [(r["v"], r["r"]) for r in got if r["r"] != round(r["v"], 2)] == []


def clusters(spark, rows):
    schema = (
        "cluster_key string, event_type string, max_trust string, event_at timestamp, first_seen_at timestamp, "
        "last_seen_at timestamp, item_count bigint, canonical_title string, canonical_summary string, "
        "version string, status string, needs_rescore boolean"
    )
    return spark.createDataFrame(rows, schema)


def cluster(key, event, trust, hours, title="Title", status="OPEN", needs=True):
    at = datetime(2026, 9, 10, 12) - timedelta(hours=hours)
    return (key, event, trust, at, at, at, 1, title, None, None, status, needs)


def test_scores_without_any_judgement(spark):
    df = clusters(
        spark, [cluster("fresh", "RELEASE", "OFFICIAL", 0), cluster("old", "OTHER", "UNKNOWN", 480), cluster("half", "RELEASE", "PRIMARY", 48)]
    )
    got = {r["cluster_key"]: r for r in sco.score_clusters(df, NOW, rules=sco.TopicRules(lexicon=None)).collect()}
    assert got["fresh"]["decision"] == "SELECTED" and got["fresh"]["score"] == 100.0
    assert got["old"]["decision"] == "FILTERED"
    parts = {p["key"]: p for p in got["half"]["parts"]}
    assert parts["timeliness"]["value"] == 50.0 and parts["novelty"]["value"] == 84.0
    assert not parts["relevance"]["available"] and parts["authority"]["value"] == 85.0


def test_judgement_beats_lexicon(spark):
    df = clusters(spark, [cluster("a", "GUIDE", "OFFICIAL", 0, "How to use ChatGPT"), cluster("b", "GUIDE", "OFFICIAL", 0, "How to use ChatGPT")])
    verdicts = spark.createDataFrame(
        [("a", 150.0, None, 10.0, None)],
        "cluster_key string, relevance double, practical_value double, audience_fit double, content_potential double",
    )
    got = {r["cluster_key"]: {p["key"]: p for p in r["parts"]} for r in sco.score_clusters(df, NOW, verdicts).collect()}
    assert got["a"]["relevance"]["source"] == "llm" and got["a"]["relevance"]["value"] == 100.0
    assert got["a"]["practical_value"]["source"] == "lexicon"
    assert got["b"]["relevance"]["value"] == 72.0 and got["b"]["relevance"]["note"] == "+chatgpt, how to"
    assert got["b"]["practical_value"]["value"] == 90.0 and not got["b"]["audience_fit"]["available"]


def test_lexicon_caps_and_counts_terms_once(values):
    lexicon = Lexicon(positive={"a": 50, "b": 50}, negative={"c": 30, "d": 40}, patterns={"x": 10})
    got = values(["a a b", "c d", "a c", ""], lambda c: relevance(c, lexicon)["value"])
    assert got == [100.0, 0.0, 60.0, 40.0]
    got = values(["x", "y"], lambda c: practical_value(c, c, F.lit("GUIDE"), F.lit(True), lexicon)["value"])
    assert got == [83.0, 68.0]


def test_rescore_moves_only_what_may_move(spark):
    df = clusters(
        spark,
        [
            cluster("due", "RELEASE", "OFFICIAL", 1),
            cluster("stale", "OTHER", "UNKNOWN", 24 * 31, status="BACKLOG"),
            cluster("chosen", "OTHER", "UNKNOWN", 1, status="SELECTED"),
            cluster("calm", "OTHER", "UNKNOWN", 1, needs=False),
        ],
    )
    table, history = sco.rescore(df, NOW, rules=sco.TopicRules(lexicon=None))
    got = {r["cluster_key"]: (r["status"], r["needs_rescore"]) for r in table.collect()}
    assert got == {
        "due": ("SELECTED", False), "stale": ("EXPIRED", False), "chosen": ("SELECTED", True), "calm": ("OPEN", False),
    }
    assert [r["cluster_key"] for r in history.collect()] == ["due"]


def test_slots_over_midnight_and_overlap(spark):
    rules = slt.SlotRules(slots=("09:00", "11:00", "23:00"), window_minutes=180)
    moments = {
        "2026-09-10 05:59:59": None, "2026-09-10 06:00:00": ("2026-09-10 06:00:00", 0),
        "2026-09-10 08:30:00": ("2026-09-10 08:00:00", 1), "2026-09-10 22:59:59": ("2026-09-10 20:00:00", 2),
        "2026-09-10 23:00:00": None,
    }
    df = spark.createDataFrame([(m,) for m in moments], "m string")
    slot = slt.open_slot(F.col("m").cast("timestamp"), rules)
    for r in df.select("m", slot.alias("s")).collect():
        want = moments[r["m"]]
        assert (r["s"] and (str(r["s"]["starts_at"]), r["s"]["slot_index"])) == want
    assert slt.parse_slots("19:00, 9:00,09:00") == ("09:00", "19:00")
    with pytest.raises(ValueError):
        slt.parse_slots("25:00")


def test_upcoming_skips_what_is_over(spark):
    got = slt.upcoming(spark, "2026-09-10 12:30:00", 2, slt.SlotRules()).collect()
    assert [(str(r["day"]), r["slot_index"]) for r in got] == [
        ("2026-09-10", 1), ("2026-09-10", 2), ("2026-09-11", 0), ("2026-09-11", 1), ("2026-09-11", 2),
    ]


def test_breaking_gate(spark):
    posts = lambda rows: spark.createDataFrame(rows, "status string, created_at timestamp, is_breaking boolean")
    at = lambda m: datetime(2026, 9, 10, 12) - timedelta(minutes=m)
    rules = slt.SlotRules()
    open_ = lambda rows: slt.breaking_gate(posts(rows), NOW, rules).first()["gate_open"]
    assert open_([])
    assert not open_([("PUBLISHED", at(30), False)])
    assert open_([("PUBLISHED", at(90), False), ("FAILED", at(1), True)])
    assert not open_([("SIMULATED", at(100), True), ("PUBLISHED", at(200), True)])
    assert open_([("SIMULATED", at(100), True), ("PUBLISHED", at(16 * 60), True)])


def test_cost_rounds_half_even_and_refuses_unknown_models(spark):
    schema = "model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint"
    prices = led.price_table(spark)
    df = spark.createDataFrame([("claude-haiku-4-5", 1_000_000, 1_000_000, 0, 0), ("claude-haiku-4-5", 0, 0, 5, 0), ("claude-haiku-4-5", 0, 0, 15, 0)], schema)
    got = [str(r["estimated_cost_usd"]) for r in led.estimate_cost(df, prices).collect()]
    assert got == ["6.000000", "0.000000", "0.000002"]
    bad = led.estimate_cost(spark.createDataFrame([("mystery", 1, 1, 0, 0)], schema), prices)
    with pytest.raises(PySparkException, match="no price known"):
        bad.collect()


def test_revisions_across_chunks(spark):
    rows = [("s", "x", "t", f, p, n) for n, (f, p) in enumerate([("a", 1), ("a", 2), ("b", None), ("b", 9), ("a", 5)])]
    rows += [("s", "y", "t", "a", 1, 7)]
    df = spark.createDataFrame(rows, "source_key string, external_id string, title string, content_fingerprint string, p int, arrival bigint")
    df = df.selectExpr(
        "*", "'u' AS url", "'u' AS canonical_url", "'h' AS url_hash", "cast(NULL AS string) AS summary",
        "cast(NULL AS string) AS content_excerpt", "timestamp_seconds(p) AS published_at",
        "timestamp_seconds(arrival) AS arrived_at",
    )
    for chunk in (1_000_000, 2, 1):
        got = {r["external_id"]: r for r in res.store_items(df, chunk=chunk).collect()}
        assert (got["x"]["revision"], got["x"]["content_fingerprint"], got["x"]["published_at"].second) == (3, "a", 5)
        assert got["y"]["revision"] == 1 and got["y"]["action"] == "NEW"
    first = res.store_items(df.filter("arrival < 2 OR arrival = 7"))
    later = {r["external_id"]: r for r in res.store_items(df.filter("arrival BETWEEN 2 AND 4"), first).collect()}
    assert (later["x"]["revision"], later["x"]["action"], later["x"]["revised"]) == (3, "UPDATED", True)
    assert (later["y"]["action"], later["y"]["revised"]) == ("UNCHANGED", False)


def test_sources_are_disabled_not_deleted(spark):
    stored = spark.createDataFrame(
        [("a", "A", "RSS", "OFFICIAL", "u", True, 60, None, None, 2), ("b", "B", "RSS", "OFFICIAL", "u", True, 60, None, None, 0)],
        "key string, name string, provider string, trust string, url string, enabled boolean, "
        "poll_interval_minutes int, last_error string, last_polled_at timestamp, consecutive_failures int",
    )
    wanted = spark.createDataFrame(
        [("a", "A2", "RSS", "PRIMARY", "v", True, 30), ("c", "C", "RSS", "UNKNOWN", "w", False, 60)],
        "key string, name string, provider string, trust string, url string, enabled boolean, poll_interval_minutes int",
    )
    got = {r["key"]: r for r in res.sync_sources(stored, wanted).collect()}
    assert (got["a"]["name"], got["a"]["action"], got["a"]["consecutive_failures"]) == ("A2", "updated", 2)
    assert (got["b"]["enabled"], got["b"]["action"]) == (False, "disabled") and got["b"]["last_error"]
    assert (got["c"]["action"], got["c"]["enabled"]) == ("created", False)


def test_texts(values):
    long = "Слово " * 40 + "конец. " + "хвост " * 200
    got = values(["``` short ```", '"' + "x" * 90 + '"', long], lambda c: cnt.clean_analysis(c, F.lit("Title.")))
    assert got[0]["text"] is None and got[0]["reason"] == "analysis too short: 5 characters"
    assert got[1]["text"] == "x" * 90
    assert got[2]["text"].endswith("конец.") and len(got[2]["text"]) <= 700
    echo = values(["Title. — " + "y" * 100], lambda c: cnt.clean_analysis(c, F.lit("Title.")))
    assert echo[0]["text"] == "y" * 100
    heads = values(['"A  title."', "x" * 111, " "], cnt.clean_headline)
    assert heads == ["A title", None, None]
    steps = values(["Open the app", "https://a.b step", "Word", "y " * 150], cnt.clean_action)
    assert steps == ["Open the app", None, None, None]
    bodies = values(["z" * 249, "z" * 250 + "\n  q ", "s. " * 900], cnt.clean_body)
    assert bodies[0]["text"] is None and bodies[1]["text"] == "z" * 250 + "\nq"
    assert len(bodies[2]["text"]) <= 1800 and bodies[2]["text"].endswith("s.")


def test_fact_line(spark):
    rows = [
        ("openai", "GPT 5", "5.1", "RELEASE", "OpenAI выпустил GPT 5 5.1."),
        ("acme", "scheduled", None, "UPDATE", "Acme выпустил обновление."),
        ("google", None, None, "GUIDE", "Google опубликовал руководство."),
        (None, "X", None, "GUIDE", None),
    ]
    df = spark.createDataFrame(rows, "v string, p string, n string, e string, want string")
    fact = cnt.fact_line(F.col("v"), F.col("p"), F.col("n"), F.col("e"))
    assert all(r["f"] == r["want"] for r in df.select(fact.alias("f"), "want").collect())


def test_publish_gate(spark):
    rows = [("ok text", "-100", False, True), (cnt.PLACEHOLDER, "-100", False, False), ("", "@x", False, True), ("", "5", True, True)]
    df = spark.createDataFrame(rows, "text string, channel_ref string, has_media boolean, publishable boolean")
    got = cnt.publish_gate(df, auto_publish=True).collect()
    assert [r["status"] for r in got] == ["SIMULATED", "BLOCKED", "BLOCKED", "SIMULATED"]
    assert len(got[2]["problems"]) == 2 and got[1]["reason"] == "unfinished draft"
    off = cnt.publish_gate(df.limit(1)).first()
    assert (off["status"], off["reason"]) == ("BLOCKED", "auto publishing is off")
