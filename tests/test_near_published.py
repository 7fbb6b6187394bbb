"""Wording close to what was published, compared block by block."""

import random

from nichelens.operators import clustering as clu


def test_near_any_meets_every_block(spark):
    draw = random.Random(3)
    held = [draw.getrandbits(64) for _ in range(60)]
    asked = [draw.getrandbits(64) for _ in range(60)]
    for value in held[:40]:
        for bit in draw.sample(range(64), draw.choice([1, 12, 13])):
            value ^= 1 << bit
        asked.append(value)
    signed = [[v - (1 << 64) if v >> 63 else v for v in side] for side in (asked, held)]
    left, right = (spark.createDataFrame([(v,) for v in side + side], "value bigint") for side in signed)
    got = [r["value"] for r in clu.near_any(left, right, 12, block=7).collect()]
    want = {v for v in signed[0] if any(bin((v ^ w) & (1 << 64) - 1).count("1") <= 12 for w in signed[1])}
    assert len(got) == len(set(got)) and set(got) == want


def test_no_value_and_no_archive(spark):
    rows = spark.createDataFrame([("a", 5), ("b", None)], "cluster_key string, simhash bigint")
    for published, want in ((rows, {"a": True, "b": False}), (rows.limit(0), {"a": False, "b": False})):
        got = clu.similar_to_published(rows, published.select("simhash")).collect()
        assert {r["cluster_key"]: r["similar_to_published"] for r in got} == want
