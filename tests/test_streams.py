"""Streams with keyed state: the answer must not depend on how rows fall into batches."""

import random

import pytest
from pyspark.sql import functions as F

from nichelens.operators.research import store_items
from nichelens.streaming import jobs


def in_batches(spark, base, df, turn, batches, start):
    for number in range(batches):
        df.filter(turn == number).coalesce(1).write.mode("append").parquet(f"{base}/landed")
        start(spark.readStream.schema(df.schema).parquet(f"{base}/landed")).awaitTermination()


def sightings(seed=1, n=400):
    r = random.Random(seed)
    return [(r.choice("ab"), r.choice(["x", "y", None]), 1_700_000_000 + r.randrange(40 * 86_400)) for _ in range(n)] + [("c", "x", 1_700_000_000)] * 3


def first_sightings(rows, window, until):
    out, last = [], {}
    for a, b, t in sorted(rows, key=lambda r: r[2]):
        if t <= until and (last.get((a, b)) is None or t >= last[a, b] + window):
            last[a, b] = t
            out.append((a, b, t))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_first_sightings_do_not_depend_on_batches(spark, tmp_path, batches):
    rows = sightings()
    df = spark.createDataFrame(rows, "source_key string, external_id string, at long")
    df = df.withColumn("arrived_at", F.timestamp_seconds("at"))
    # Rows come an hour early or late at most.
    place = F.col("at") - 1_700_000_000 + F.pmod(F.xxhash64("at", "source_key"), F.lit(3600))
    turn = F.least(F.floor(place * batches / (40 * 86_400)), F.lit(batches - 1))
    keys = ("source_key", "external_id")
    run = lambda new: jobs.stream_first_sightings(new, f"{tmp_path}/out", f"{tmp_path}/state", keys, window_seconds=5 * 86_400, lateness="2 hours")
    in_batches(spark, tmp_path, df, turn, batches, run)
    got = spark.read.parquet(f"{tmp_path}/out").select(*keys, F.unix_seconds("arrived_at")).collect()
    want = first_sightings(rows, 5 * 86_400, max(t for *_, t in rows) - 7200)
    assert sorted((tuple(r) for r in got), key=str) == want and len(want) > 20


def arrivals(spark, seed=2, n=300):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        text = r.choice(["one", "two", "three"])
        rows.append((r.choice("ab"), str(r.randrange(12)), f"u{k}", text, f"f-{text}", None if r.random() < 0.5 else 1_700_000_000 + k, 1_700_000_000 + 10 * k, k))
    df = spark.createDataFrame(rows, "source_key string, external_id string, url string, title string, content_fingerprint string, published long, at long, arrival long")
    return df.select(
        "source_key", "external_id", "url", F.col("url").alias("canonical_url"), F.md5("url").alias("url_hash"), "title",
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("content_excerpt"), "content_fingerprint",
        F.lit("me").alias("author"), F.create_map(F.lit("k"), F.col("title")).alias("raw_metadata"),
        F.timestamp_seconds("published").alias("published_at"), F.timestamp_seconds("at").alias("arrived_at"), "arrival",
    )


def plain(df, columns):
    rows = df.withColumn("raw_metadata", F.to_json("raw_metadata")).select(*columns).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("batches", [1, 4])
def test_items_in_state_equal_the_batch_operator(spark, tmp_path, batches):
    df = arrivals(spark)
    turn = F.floor(F.col("arrival") * batches / 300)
    in_batches(spark, tmp_path, df, turn, batches, lambda new: jobs.stream_items(new, f"{tmp_path}/out", f"{tmp_path}/state"))
    want = store_items(df)
    columns = [c for c in want.columns if c not in ("action", "revised", "status")]
    assert plain(jobs.latest_items(spark, f"{tmp_path}/out"), columns) == plain(want, columns)


def test_a_small_batch_writes_little(spark, tmp_path):
    df = arrivals(spark)
    run = lambda new: jobs.stream_items(new, f"{tmp_path}/out", f"{tmp_path}/state")
    in_batches(spark, tmp_path, df, F.when(F.col("arrival") < 299, 0).otherwise(1), 2, run)
    log = spark.read.parquet(f"{tmp_path}/out")
    last = df.filter("arrival = 299").first()
    rows = log.select("source_key", "external_id", F.col("_metadata.file_modification_time").alias("at"), "sightings").collect()
    newest = max(r["at"] for r in rows)
    assert [(r["source_key"], r["external_id"], r["sightings"]) for r in rows if r["at"] == newest] == [(last["source_key"], last["external_id"], 1)]
    # A restart without new files adds nothing.
    run(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/landed")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)
