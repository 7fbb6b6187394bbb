"""The set-based matcher against a literal one-item-at-a-time model."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nichelens.operators import clustering as c

HOUR = 3600
SCHEMA = (
    "item_id string, discovered bigint, event bigint, url_hash string, fingerprint string, "
    "entity_key string, simhash bigint, token_count bigint, vendor string, version string"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def random_items(rng, count, start=0, crowded=False):
    items = []
    bases = [rng.getrandbits(64) for _ in range(4)]
    for i in range(count):
        value = rng.choice(bases) if rng.random() < (0.95 if crowded else 0.7) else rng.getrandbits(64)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 7])):
            value ^= 1 << rng.randrange(64)
        event = rng.randrange(0, 20 * 24) * HOUR + rng.choice([0, 0, 1, 1800])
        vendor = rng.choice([None, "a", "b"])
        version = rng.choice([None, None, "1.0", "2.0"])
        key = None
        if vendor and version and rng.random() < 0.5:
            key = f"{vendor}:-:{version}:announcement:w{event // (7 * 24 * HOUR)}"
        items.append(
            {
                "item_id": f"i{start + i:04d}",
                "discovered": (start + i) * 600 + rng.randrange(3) * 600,
                "event": event,
                "url_hash": f"u{rng.randrange(count * 3):032d}",
                "fingerprint": f"f{rng.randrange(count // 2)}",
                "entity_key": key,
                "simhash": value - (1 << 64) if value >= 1 << 63 else value,
                "token_count": rng.choice([3, 8, 20, 20]),
                "vendor": vendor,
                "version": version,
            }
        )
    return items


def veto(a, b):
    return bool(
        (a["version"] and b["version"] and a["version"] != b["version"])
        or (a["vendor"] and b["vendor"] and a["vendor"] != b["vendor"])
    )


def literal_match(item, candidates):
    near = [o for o in candidates if abs(o["event"] - item["event"]) <= 72 * HOUR]
    for o in candidates:
        if o["url_hash"] == item["url_hash"]:
            return o, "URL", 1.0
    for o in near:
        if o["fingerprint"] == item["fingerprint"] and not veto(o, item):
            return o, "FINGERPRINT", 1.0
    for o in near:
        if item["entity_key"] and o["entity_key"] == item["entity_key"]:
            return o, "ENTITY", None
    best = None
    if item["token_count"] >= 5:
        for o in near:
            if o["token_count"] < 5 or veto(o, item):
                continue
            d = ((o["simhash"] ^ item["simhash"]) & (2**64 - 1)).bit_count()
            if d <= 6 and (best is None or d < best[1]):
                best = (o, d)
    return (best[0], "SIMHASH", round(1 - best[1] / 64, 4)) if best else None


def literal_run(new, stored, cluster_of, keys):
    """One run: returns (membership, matched_by, similarity) of the new items."""
    candidates = sorted(stored, key=lambda s: (-s["discovered"], s["item_id"]))
    found = {}
    for item in sorted(new, key=lambda s: (s["discovered"], s["item_id"])):
        hit = literal_match(item, candidates)
        if hit:
            cluster, how, similarity = cluster_of[hit[0]["item_id"]], hit[1], hit[2]
        else:
            cluster = item["entity_key"] or f"item:{item['url_hash'][:32]}"
            keys.add(cluster)
            how, similarity = "SEED", None
        cluster_of[item["item_id"]] = cluster
        found[item["item_id"]] = (cluster, how, similarity)
        candidates.append(item)
    return found


def frame(spark, items):
    rows = [tuple(i[f] for f in FIELDS) for i in items]
    return spark.createDataFrame(rows, SCHEMA).select(
        "*",
        F.timestamp_seconds("discovered").alias("discovered_at"),
        F.timestamp_seconds("event").alias("event_at"),
    ).drop("discovered", "event")


def as_dict(df):
    return {r["item_id"]: (r["cluster_key"], r["matched_by"], r["similarity"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "crowded"), [(1, 4_000_000), (2, 4_000_000), (3, 5), (4, 0)])
def test_full_build_equals_the_sequential_loop(spark, seed, crowded):
    rng = random.Random(seed)
    items = random_items(rng, 160, crowded=crowded < 10)
    rules = c.ClusterRules(crowded=crowded, salts=3)
    got = as_dict(c.cluster_items(frame(spark, items), rules=rules))
    assert got == literal_run(items, [], {}, set())
    assert {how for _, how, _ in got.values()} == {"SEED", "URL", "FINGERPRINT", "ENTITY", "SIMHASH"}


@pytest.mark.parametrize("seed", [11, 12])
def test_incremental_run_equals_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    first, second = random_items(rng, 90), random_items(rng, 60, start=90)
    cluster_of, keys = {}, set()
    literal_run(first, [], cluster_of, keys)
    members = spark.createDataFrame(list(cluster_of.items()), "item_id string, cluster_key string")
    recent = [i for i in first if i["discovered"] >= 200 * 60]
    clusters = spark.createDataFrame([(k,) for k in keys], "cluster_key string")
    got = as_dict(
        c.cluster_items(
            frame(spark, second),
            stored=frame(spark, recent),
            stored_membership=members,
            stored_clusters=clusters,
        )
    )
    assert got == literal_run(second, recent, cluster_of, keys)


def test_bands_find_every_close_pair_once(spark):
    rng = random.Random(7)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(12):
            near = base
            for _ in range(rng.randrange(1, 9)):
                near ^= 1 << rng.randrange(64)
            values.add(near)
    values = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in values)
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "bucket bigint, value bigint")
    want = defaultdict(int)
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            d = ((a ^ b) & (2**64 - 1)).bit_count()
            if 0 < d <= 6 and abs(i % 3 - j % 3) <= 1:
                want[(i % 3, a, b, d)] += 1
    for crowded in (10**9, 30, 0):
        got = c.similar_values(df, df, c.ClusterRules(crowded=crowded, salts=4)).collect()
        counted = defaultdict(int)
        for r in got:
            counted[(r["bucket"], r["value"], r["other"], r["distance"])] += 1
        assert counted == want


def test_long_chains_resolve(spark):
    edges = spark.range(0, 700).selectExpr("id AS ord", "greatest(id - 1, 0) AS ptr")
    roots = c.resolve_roots(edges).collect()
    assert len(roots) == 700 and all(r["root"] == 0 for r in roots)


def test_hot_key_with_one_instant(spark):
    """A third of all items are one text at one instant; nothing pairs up."""
    entries = spark.range(0, 30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS key", "'' AS vendor",
        "'' AS version", "cast(id % 7 AS bigint) AS event_s", "id AS ord",
    )
    found = c.earliest_within(entries, entries.drop("ord"), 72)
    assert found.count() == 20_000 + 7
    assert found.filter("key = 'hot'").select(F.max("first_ord")).first()[0] == 0


def test_cluster_table_follows_trust(spark):
    items = spark.createDataFrame(
        [
            ("a", "First", "s1", "UNKNOWN", 10), ("b", "Second", "s2", "OFFICIAL", 20),
            ("c", "Third", "s3", "OFFICIAL", 30), ("d", "Alone", None, "PRIMARY", 40),
        ],
        "item_id string, title string, summary string, trust string, at bigint",
    ).selectExpr("*", "timestamp_seconds(at) AS discovered_at", "cast(NULL AS timestamp) AS published_at")
    sig = items.selectExpr(
        "item_id", "concat('v', item_id) AS vendor", "'p' AS product", "'1.0' AS version",
        "'RELEASE' AS event_type", "1L AS simhash",
    )
    members = items.selectExpr("item_id", "CASE WHEN item_id = 'd' THEN 'k2' ELSE 'k1' END AS cluster_key")
    got = {r["cluster_key"]: r for r in c.cluster_table(members, items, sig).collect()}
    row = got["k1"]
    assert (row["seed_item_id"], row["vendor"], row["canonical_summary"]) == ("a", "va", "s1")
    assert (row["primary_item_id"], row["canonical_title"], row["max_trust"]) == ("b", "Second", "OFFICIAL")
    assert row["item_count"] == 3 and got["k2"]["item_count"] == 1


def test_merge_keeps_identity_and_takes_stronger_title(spark):
    columns = (
        "cluster_key string, seed_item_id string, event_type string, canonical_summary string, vendor string, "
        "product string, version string, simhash bigint, event_at bigint, first_seen_at bigint, "
        "primary_item_id string, canonical_title string, max_trust string, last_seen_at bigint, "
        "item_count bigint, status string, needs_rescore boolean"
    )
    row = lambda key, item, trust, at, n, status: (
        key, item, "OTHER", "s", None, None, None, 1, at, at, item, f"T{item}", trust, at, n, status, False
    )
    current = spark.createDataFrame([row("k", "a", "UNKNOWN", 1, 2, "EXPIRED"), row("x", "z", "UNKNOWN", 1, 1, "OPEN")], columns)
    fresh = spark.createDataFrame([row("k", "b", "OFFICIAL", 9, 3, "OPEN"), row("n", "c", "UNKNOWN", 9, 1, "OPEN")], columns)
    got = {r["cluster_key"]: r for r in c.merge_clusters(current, fresh).collect()}
    k = got["k"]
    assert (k["seed_item_id"], k["primary_item_id"], k["canonical_title"]) == ("a", "b", "Tb")
    assert (k["item_count"], k["last_seen_at"], k["status"], k["needs_rescore"]) == (5, 9, "EXPIRED", True)
    assert got["x"]["needs_rescore"] is False and got["n"]["status"] == "OPEN"


def test_similar_to_published(spark):
    rng = random.Random(5)
    archive = [rng.getrandbits(63) for _ in range(20)]
    probes = []
    for v in archive:
        for bits in (0, 5, 12, 14):
            near = v
            for b in rng.sample(range(63), bits):
                near ^= 1 << b
            probes.append(near)
    probes.append(None)
    clusters = spark.createDataFrame([(i, p) for i, p in enumerate(probes)], "i int, simhash bigint")
    published = spark.createDataFrame([(a,) for a in archive], "simhash bigint")
    got = c.similar_to_published(clusters, published).collect()
    for r in got:
        want = r["simhash"] is not None and any((r["simhash"] ^ a).bit_count() <= 12 for a in archive)
        assert r["similar_to_published"] == want


def test_near_pairs_are_folded_where_they_are_found(spark):
    """Thousands of variants in one window: every item sends on a bounded number of rows, and the nearest earlier one wins."""
    import random

    r = random.Random(9)
    base = r.getrandbits(63)
    values = [base ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 3))) for _ in range(1500)]
    day = 1_704_067_200
    rows = [(i, v, day + r.randrange(86_400), r.choice(["", "", "a", "b"]), r.choice(["", "1", "2"])) for i, v in enumerate(values)]
    sig = spark.createDataFrame(rows, "ord long, simhash long, event_s long, vendor string, version string").withColumn("reliable", F.lit(True))
    for crowded in (4_000_000, 2_000):
        rules = c.ClusterRules(crowded=crowded, salts=4)
        got = {x["ord"]: (x["distance"], x["parent"]) for x in c._similar(sig, sig, rules).collect()}
        want = {}
        for i, v, t, a, b in rows:
            near = [
                ((v ^ w).bit_count(), j)
                for j, w, u, x, y in rows[:i]
                if v != w and (v ^ w).bit_count() <= rules.max_distance and abs(t - u) <= 72 * 3600 and (not a or not x or a == x) and (not b or not y or b == y)
            ]
            if near:
                want[i] = min(near)
        assert got == want and len(want) > 1000
