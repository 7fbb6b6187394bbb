"""Labels, products and notes are not cut unless asked for."""

from datetime import datetime

from pyspark.sql import functions as F

from nichelens.functions import entities as e
from nichelens.functions import normalize as n
from nichelens.functions.lexicon import Lexicon
from nichelens.operators import topics as sco


def test_long_labels_stay_apart(spark):
    df = spark.createDataFrame([("a" * 200 + x,) for x in "bc"], "c string")
    key = n.build_dedupe_key(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("c"))
    rows = df.select(n.slugify(F.col("c")).alias("s"), key.alias("k"), n.slugify(F.col("c"), 160).alias("cut")).collect()
    assert [r.s for r in rows] == ["a" * 200 + "b", "a" * 200 + "c"]
    assert rows[0].k != rows[1].k and rows[0].cut == rows[1].cut == "a" * 160


def test_long_products_stay_apart(spark):
    df = spark.createDataFrame([("openai " + "p" * 70 + x,) for x in "bc"], "c string")
    find = lambda **more: e.detect_product(F.col("c"), F.lit("openai"), e.EntityRules(), **more)
    rows = df.select(find().alias("p"), find(max_length=64).alias("cut")).collect()
    assert [r.p for r in rows] == ["p" * 70 + "b", "p" * 70 + "c"] and rows[0].cut == rows[1].cut == "p" * 64


def test_notes_list_all_terms(spark):
    terms = [f"term{k}" for k in range(9)]
    at = datetime(2026, 9, 10, 12)
    row = ("a", "GUIDE", "OFFICIAL", at, at, at, 1, " ".join(terms), None, None, "OPEN", True)
    df = spark.createDataFrame(
        [row],
        "cluster_key string, event_type string, max_trust string, event_at timestamp, first_seen_at timestamp, last_seen_at timestamp, "
        "item_count bigint, canonical_title string, canonical_summary string, version string, status string, needs_rescore boolean",
    )

    def listed(**more):
        rules = sco.TopicRules(lexicon=Lexicon(positive=dict.fromkeys(terms, 1.0), negative={"absent": 1.0}), **more)
        parts = {p["key"]: p for p in sco.score_clusters(df, "2026-09-10 12:00:00", rules=rules).first()["parts"]}
        return parts["relevance"]["note"].count("term")

    assert listed() == 9 and listed(note_terms=6) == 6
