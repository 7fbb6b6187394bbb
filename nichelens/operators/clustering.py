"""Many reports, one event: near-duplicate matching and event clusters.

Every new item looks for the earliest (or, by wording, the closest) item before
it in four layers: same address, same content, same named thing, similar
wording. A match depends only on the signatures of earlier items, so the whole
run is set-based: candidate look-ups by key and time, then a parent forest.

Nothing here pairs up the members of a group. The first three layers, and
wording that is identical bit for bit, reduce to "earliest entry of this key
within 72 hours", answered with running minima over distinct instants. Only
*different* wording values are compared with each other, through banded keys
that are refined wherever a band is crowded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelens.functions.entities import (
    EntityRules,
    detect_event_type,
    detect_product,
    detect_vendor,
    entity_key,
    fallback_key,
    resolve_version,
)
from nichelens.functions.normalize import blank_to_null
from nichelens.functions.textkeys import (
    MIN_TOKENS,
    canonicalize_url,
    content_fingerprint,
    fold_text,
    nfkc,
    simhash_table,
    tokenize,
    url_hash,
)
from nichelens.session import materialize
from nichelens.vocab import TRUST_ORDER

WINDOW_HOURS = 72
MAX_DISTANCE = 6
CANDIDATE_DAYS = 7
LAYERS = {1: "URL", 2: "FINGERPRINT", 3: "ENTITY", 4: "SIMHASH"}
_ANY = "\x01any"


@dataclass(frozen=True)
class ClusterRules:
    """Thresholds of the matcher.

    ``crowded`` is the number of comparisons one band value may cost before it
    is split by further bits; it shapes the work, never the result.
    """

    window_hours: int = WINDOW_HOURS
    max_distance: int = MAX_DISTANCE
    min_tokens: int = MIN_TOKENS
    crowded: int = 4_000_000
    salts: int = 32
    entities: EntityRules = field(default_factory=EntityRules)


# --------------------------------------------------------------- signatures


def build_signatures(
    items: DataFrame, rules: ClusterRules | None = None, urls: DataFrame | None = None
) -> DataFrame:
    """Signature columns of ``items``.

    Needs ``item_id, url, title, summary, content_excerpt, published_at,
    discovered_at, version_hint, product_hint``; other columns stay behind.
    ``event_at`` has whole seconds, the resolution of published dates. Addresses
    that stand in a table of their own are given as ``urls(item_id, url)``, which
    take the place of an item's; they meet its keys, so that no text is moved.
    """
    rules = rules or ClusterRules()
    # Text goes through NFKC once per part; everything else folds that result.
    base = items.select(
        "item_id",
        "discovered_at",
        F.date_trunc("second", F.coalesce("published_at", "discovered_at")).alias("event_at"),
        "version_hint",
        blank_to_null(F.col("product_hint")).alias("explicit_product"),
        "url",
        F.col("title").alias("raw_title"),
        nfkc(F.col("title")).alias("t"),
        nfkc(F.col("summary")).alias("s"),
        nfkc(F.col("content_excerpt")).alias("x"),
    )
    # Each part is folded once; blanks end a fold, so the parts may be joined afterwards.
    parts = base.withColumns({f"f{c}": fold_text(F.col(c)) for c in "tsx"}).drop("t", "s", "x")
    folded = parts.select(
        *[c for c in parts.columns if c not in ("ft", "fs", "fx")],
        F.col("ft").alias("title_text"),
        F.trim(F.concat(F.coalesce("ft", F.lit("")), F.lit(" "), F.coalesce("fs", F.lit("")))).alias("text"),
        content_fingerprint(F.col("ft"), F.col("fs"), F.col("fx")).alias("fingerprint"),
    )
    named = folded.withColumn("vendor", detect_vendor(F.col("text"), rules.entities)).withColumn(
        "event_type", detect_event_type(F.col("text"), rules.entities)
    )
    detailed = named.withColumn(
        "version", resolve_version(F.col("version_hint"), F.col("raw_title"))
    ).withColumn(
        "product",
        F.coalesce(
            "explicit_product",
            detect_product(F.col("title_text"), F.col("vendor"), rules.entities),
        ),
    )
    keyed = detailed.withColumn(
        "entity_key",
        entity_key(
            F.col("vendor"),
            F.col("explicit_product"),
            F.col("version"),
            F.col("event_type"),
            F.col("event_at"),
        ),
    )
    words = keyed.filter(F.col("item_id").isNotNull()).withColumn("words", tokenize(F.col("text")))
    carried = [c for c in keyed.columns if c not in ("item_id", "raw_title", "title_text", "text", "version_hint")]
    hashed = simhash_table(words, "item_id", "words", tuple(carried))
    if urls is not None:
        own = urls.select("item_id", F.col("url").alias("own_url"))
        hashed = hashed.join(own, "item_id", "left").withColumn("url", F.coalesce("own_url", "url")).drop("own_url")
    return hashed.withColumn("url_hash", url_hash(canonicalize_url(F.col("url")))).drop("url")


# ------------------------------------------- earliest entry within a window


def _cells(vendor: str, version: str, own_and_any: bool) -> Column:
    """Class cells a row is stored under, or the cells a probe has to look into.

    A row is filed under its own vendor/version and under "any"; a probe that
    names a vendor accepts the same or an unnamed one, a probe that does not
    accepts any. Compatible classes thus meet by equality.
    """

    def options(c: Column) -> Column:
        if own_and_any:
            return F.array(c, F.lit(_ANY))
        return F.when(c == "", F.array(F.lit(_ANY))).otherwise(F.array(c, F.lit("")))

    return F.flatten(
        F.transform(
            options(F.col(vendor)),
            lambda a: F.transform(
                options(F.col(version)), lambda b: F.concat_ws("\x02", a, b)
            ),
        )
    )


def earliest_within(
    entries: DataFrame, probes: DataFrame, hours: int, ignore_class: bool = False
) -> DataFrame:
    """Smallest ``ord`` of a compatible entry of the same ``key`` within the window.

    ``entries(key, vendor, version, event_s, ord)`` and ``probes(key, vendor,
    version, event_s)`` with ``''`` for an unnamed vendor or version. Time is
    cut into buckets one window wide: the window around a probe is the tail of
    the bucket before, its own bucket, and the head of the bucket after, so two
    running minima and a bucket minimum answer every probe without pairing.
    A (key, class, bucket) holds at most one entry per second, however many
    items share it.
    """
    width = hours * 3600
    cells = (lambda stored: F.array(F.lit(""))) if ignore_class else (
        lambda stored: _cells("vendor", "version", stored)
    )
    bucket = F.floor(F.col("event_s") / F.lit(width)).cast("bigint")
    offset = F.pmod(F.col("event_s"), F.lit(width))
    stored = (
        entries.select("key", F.explode(cells(True)).alias("cell"), bucket.alias("bucket"), offset.alias("at"), "ord")
        .groupBy("key", "cell", "bucket", "at")
        .agg(F.min("ord").alias("ord"))
    )
    identity = ["key", "vendor", "version", "event_s"]
    asked = (
        probes.select(*identity)
        .distinct()
        .select(*identity, bucket.alias("b"), offset.alias("at"), F.explode(cells(False)).alias("cell"))
        .select(
            *identity,
            "cell",
            "at",
            F.inline(
                F.array(
                    F.struct((F.col("b") - 1).alias("bucket"), F.lit("tail").alias("part")),
                    F.struct(F.col("b").alias("bucket"), F.lit("whole").alias("part")),
                    F.struct((F.col("b") + 1).alias("bucket"), F.lit("head").alias("part")),
                )
            ),
        )
    )
    mixed = stored.unionByName(asked, allowMissingColumns=True)
    group = Window.partitionBy("key", "cell", "bucket")
    head = group.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = group.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        F.when(F.col("part") == "head", F.min("ord").over(head))
        .when(F.col("part") == "tail", F.min("ord").over(tail))
        .otherwise(F.min("ord").over(group))
    )
    return (
        mixed.withColumn("found", found)
        .filter(F.col("part").isNotNull() & F.col("found").isNotNull())
        .groupBy(*identity)
        .agg(F.min("found").alias("first_ord"))
    )


def _first_by_key(sig: DataFrame, queries: DataFrame, key: str, rules: ClusterRules, ignore_class: bool) -> DataFrame:
    """``(ord, parent)`` for queries whose key has an earlier entry in the window."""
    fields = [F.col(key).alias("key"), "vendor", "version", "event_s", "ord"]
    entries = sig.filter(F.col(key).isNotNull()).select(*fields)
    asking = queries.filter(F.col(key).isNotNull()).select(*fields)
    found = earliest_within(entries, asking.drop("ord"), rules.window_hours, ignore_class)
    return (
        asking.join(found, ["key", "vendor", "version", "event_s"])
        .filter(F.col("first_ord") < F.col("ord"))
        .select("ord", F.col("first_ord").alias("parent"))
    )


# ------------------------------------------------------------ similar wording


def _split_mask(mask: int, parts: int) -> list[int]:
    """Cut the set bits of ``mask`` into ``parts`` runs of nearly equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    size, extra = divmod(len(bits), parts)
    runs, start = [], 0
    for part in range(parts):
        stop = start + size + (1 if part < extra else 0)
        runs.append(sum(1 << b for b in bits[start:stop]))
        start = stop
    return runs


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _bands(level: int, max_distance: int) -> list[tuple[int, list[int]]]:
    """``(mask, masks of earlier sibling bands)`` of every band at a level.

    Level 1 cuts 64 bits into ``max_distance + 1`` bands: two values within the
    distance agree on one of them. Each next level cuts the bits a band leaves
    over in the same way, so the guarantee holds inside every crowded band.
    """
    parts = max_distance + 1
    full = (1 << 64) - 1
    found: list[tuple[int, list[int]]] = [(0, [])]
    for _ in range(level):
        following = []
        for mask, earlier in found:
            pieces = _split_mask(full & ~mask, parts)
            for i, piece in enumerate(pieces):
                following.append((mask | piece, earlier + pieces[:i]))
        found = following
    return found


def _band_columns(level: int, max_distance: int, parent: str | None) -> Column:
    """``array<struct<band, key>>`` of one value; only children of ``parent`` if given."""
    masks = [_signed(mask) for mask, _ in _bands(level, max_distance)]
    parts = max_distance + 1
    table = F.array(*[F.lit(m).cast("bigint") for m in masks])
    if parent is None:
        numbers = F.sequence(F.lit(0), F.lit(parts - 1))
    else:
        numbers = F.sequence(F.col(parent) * parts, F.col(parent) * parts + (parts - 1))
    return F.transform(
        numbers,
        lambda i: F.struct(
            i.alias("band"), F.col("value").bitwiseAND(F.get(table, i)).alias("key")
        ),
    )


def _verified(pairs: DataFrame, level: int, max_distance: int) -> DataFrame:
    """Keep pairs within the distance, each only in the first band they share."""
    earlier = F.array(
        *[
            F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks]).cast("array<bigint>")
            for _, masks in _bands(level, max_distance)
        ]
    )
    differing = F.col("value").bitwiseXOR(F.col("other"))
    distance = F.bit_count(differing)
    first_shared = F.forall(
        F.get(earlier, F.col("band")), lambda m: differing.bitwiseAND(m) != 0
    )
    near = pairs.withColumn("distance", distance)
    return near.filter((F.col("distance") > 0) & (F.col("distance") <= max_distance) & first_shared)


def near_values(
    left: DataFrame,
    right: DataFrame,
    rules: ClusterRules,
    fold: Callable[[DataFrame], DataFrame],
    levels: int = 3,
) -> DataFrame:
    """What ``fold`` makes of the pairs of different values within the distance.

    ``left(slot, value, ...)`` meets ``right(slot, value, ...)`` of the same slot;
    pairs have all columns of both, the right value as ``other``, and their
    ``distance``. Only folded rows leave the task in which a pair is found: no
    pair is shuffled or written. A band value that would cost more than
    ``rules.crowded`` comparisons is not joined but split by the next level of
    bands; at the last level it is salted instead, so no task receives it whole.
    Every pair is seen exactly once; the folded rows of all levels are united.
    """
    d = rules.max_distance
    asked, held = left.columns, right.columns
    parent: str | None = None
    found: DataFrame | None = None
    on = ["slot", "band", "key"]
    for level in range(1, levels + 1):
        left = left.select(*asked, F.inline(_band_columns(level, d, parent)))
        right = right.select(*held, F.inline(_band_columns(level, d, parent)))
        load = (
            left.groupBy(*on).agg(F.count("*").alias("asking"))
            .join(right.groupBy(*on).agg(F.count("*").alias("stored")), on)
            .filter(F.col("asking") * F.col("stored") > rules.crowded)
            .select(*on)
        )
        crowded = materialize(load, "crowded-bands")
        any_crowded = not crowded.isEmpty()
        last = level == levels
        if any_crowded and last:
            hot = crowded.withColumn("hot", F.lit(True))
            salt = F.when(
                F.col("hot"), F.pmod(F.xxhash64("value"), F.lit(rules.salts)).cast("int")
            ).otherwise(F.lit(0))
            l_rows = left.join(hot, on, "left").withColumn("salt", salt).drop("hot")
            r_rows = right.join(hot, on, "left").withColumn(
                "salt",
                F.explode(
                    F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(rules.salts - 1))).otherwise(
                        F.array(F.lit(0))
                    )
                ),
            ).drop("hot")
            keys = [*on, "salt"]
        else:
            l_rows = left.join(crowded, on, "left_anti") if any_crowded else left
            r_rows, keys = right, on
        pairs = l_rows.join(r_rows.withColumnRenamed("value", "other"), keys)
        folded = fold(_verified(pairs, level, d))
        found = folded if found is None else found.unionByName(folded)
        if not any_crowded or last:
            break
        left = left.join(crowded, on, "left_semi").select(*asked, F.col("band").alias("parent"))
        right = right.join(crowded, on, "left_semi").select(*held, F.col("band").alias("parent"))
        parent = "parent"
    return found


def similar_values(
    queries: DataFrame, candidates: DataFrame, rules: ClusterRules, levels: int = 3
) -> DataFrame:
    """``(bucket, value, other, distance)``: all pairs, for distinct ``(bucket, value)`` of both sides.

    A query is compared with its own and the two neighbouring time buckets. The
    result has as many rows as there are pairs; see :func:`near_values`.
    """
    slots = F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("slot")
    left, right = queries.select("bucket", slots, "value"), candidates.select(F.col("bucket").alias("slot"), "value")
    return near_values(left, right, rules, lambda pairs: pairs.select("bucket", "value", "other", "distance"), levels)


#: Distances stand above so many bits, order numbers below them.
_ORD_BITS = 56


def _similar(sig: DataFrame, queries: DataFrame, rules: ClusterRules) -> DataFrame:
    """``(ord, parent, distance)`` by wording for queries without an exact twin.

    Time is cut into buckets one window wide. Stored items of one value, class
    and bucket are one row with their seconds; a pair gives the earliest of them
    that the query's window holds, and each query keeps the least (distance,
    ord) of all its pairs as one number, folded where the pairs are found.
    """
    width = rules.window_hours * 3600
    bucket = F.floor(F.col("event_s") / F.lit(width)).cast("bigint")
    at = F.pmod(F.col("event_s"), F.lit(width))
    value = F.col("simhash").alias("value")
    seconds = sig.filter("reliable").select(
        bucket.alias("slot"), value, F.col("vendor").alias("its_vendor"), F.col("version").alias("its_version"), at.alias("its_at"), "ord"
    )
    cell = ["slot", "value", "its_vendor", "its_version"]
    seconds = seconds.groupBy(*cell, "its_at").agg(F.min("ord").alias("ord"))
    # At most one entry a second of the window, however many items share a value.
    entries = F.collect_list(F.struct("its_at", "ord"))
    stored = seconds.groupBy(*cell).agg(
        F.count("*").alias("size"), F.min("ord").alias("first"), F.min("its_at").alias("only_at"), entries.alias("entries")
    ).withColumn("entries", F.when(F.col("size") > 1, F.col("entries")))
    asking = queries.select(
        "ord", "vendor", "version", value, bucket.alias("bucket"), at.alias("at"),
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("slot"),
    )

    def fold(pairs: DataFrame) -> DataFrame:
        def held(second: Column) -> Column:
            return F.when(F.col("slot") < F.col("bucket"), second >= F.col("at")).otherwise(second <= F.col("at"))

        several = F.array_min(F.transform(F.filter("entries", lambda e: held(e["its_at"])), lambda e: e["ord"]))
        parent = (
            F.when(F.col("slot") == F.col("bucket"), F.col("first"))
            .when(F.col("size") == 1, F.when(held(F.col("only_at")), F.col("first")))
            .otherwise(several)
        )
        fits = [(F.col(c) == "") | (F.col(f"its_{c}") == "") | (F.col(c) == F.col(f"its_{c}")) for c in ("vendor", "version")]
        best = F.shiftleft(F.col("distance").cast("long"), _ORD_BITS) + F.col("parent")
        told = pairs.filter(fits[0] & fits[1]).select("ord", "distance", parent.alias("parent")).filter("parent < ord")
        return told.groupBy("ord").agg(F.min(best).alias("best"))

    found = near_values(asking, stored, rules, fold).groupBy("ord").agg(F.min("best").alias("best"))
    return found.select(
        "ord",
        F.col("best").bitwiseAND((1 << _ORD_BITS) - 1).alias("parent"),
        F.shiftright("best", _ORD_BITS).cast("int").alias("distance"),
    )


# ----------------------------------------------------------------- the run


def _ordered(signatures: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Slim working table with a unique, order-preserving ``ord``.

    Candidates are looked at stored ones first, newest first, then this run's
    items in order of discovery. A range sort followed by partition-ordered ids
    numbers them without a single-task window.
    """
    columns = [
        "item_id", "discovered_at", "event_at", "url_hash", "fingerprint", "entity_key",
        "simhash", "token_count", "vendor", "version",
    ]
    micros = F.unix_micros("discovered_at")
    rows = signatures.select(*columns, F.lit(1).alias("fresh"), micros.alias("turn"))
    if stored is not None:
        rows = stored.select(*columns, F.lit(0).alias("fresh"), (-micros).alias("turn")).unionByName(
            rows
        )
    return rows.orderBy("fresh", "turn", "item_id").withColumn(
        "ord", F.monotonically_increasing_id()
    )


def match_items(
    signatures: DataFrame,
    stored: DataFrame | None = None,
    rules: ClusterRules | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(working table, matches).

    Matches are ``(ord, parent, layer, distance)`` for new items that found a
    match; the first layer that matches wins. ``stored`` are the signatures of
    already clustered candidates.
    """
    rules = rules or ClusterRules()
    numbered = _ordered(signatures, stored)
    sig = materialize(
        numbered.select(
            "ord",
            "item_id",
            "fresh",
            "discovered_at",
            "url_hash",
            "fingerprint",
            "entity_key",
            "simhash",
            (F.col("token_count") >= rules.min_tokens).alias("reliable"),
            F.coalesce("vendor", F.lit("")).alias("vendor"),
            F.coalesce("version", F.lit("")).alias("version"),
            F.unix_seconds("event_at").alias("event_s"),
        ),
        "signatures",
    )
    new = sig.filter("fresh = 1")
    first_url = sig.groupBy("url_hash").agg(F.min("ord").alias("parent"))
    by_url = (
        new.select("ord", "url_hash")
        .join(first_url, "url_hash")
        .filter(F.col("parent") < F.col("ord"))
        .select("ord", "parent")
    )
    by_content = _first_by_key(sig, new, "fingerprint", rules, ignore_class=False)
    by_entity = _first_by_key(sig, new, "entity_key", rules, ignore_class=True)
    strict = materialize(
        _best(
            by_url.withColumn("layer", F.lit(1))
            .unionByName(by_content.withColumn("layer", F.lit(2)))
            .unionByName(by_entity.withColumn("layer", F.lit(3)))
        ),
        "strict-matches",
    )
    open_items = new.filter("reliable").join(strict.select("ord"), "ord", "left_anti")
    twins = materialize(
        _first_by_key(sig.filter("reliable"), open_items, "simhash", rules, ignore_class=False),
        "twin-matches",
    )
    lone = open_items.join(twins.select("ord"), "ord", "left_anti")
    similar = _similar(sig, lone, rules)
    none = F.lit(None).cast("int")
    matches = (
        strict.withColumn("distance", none)
        .unionByName(twins.withColumn("layer", F.lit(4)).withColumn("distance", F.lit(0)))
        .unionByName(similar.withColumn("layer", F.lit(4)))
    )
    return sig, materialize(matches, "matches")


def _best(layered: DataFrame) -> DataFrame:
    """Parent of the first layer that has one."""
    found = layered.groupBy("ord").agg(
        *[F.min(F.when(F.col("layer") == n, F.col("parent"))).alias(f"l{n}") for n in (1, 2, 3)]
    )
    layer = F.when(F.col("l1").isNotNull(), 1).when(F.col("l2").isNotNull(), 2).otherwise(3)
    return found.select("ord", F.coalesce("l1", "l2", "l3").alias("parent"), layer.alias("layer"))


def similarity(layer: Column, distance: Column) -> Column:
    """1 for the same address or content, none by entity, 1 - d/64 by wording."""
    return (
        F.when(layer.isin(1, 2), F.lit(1.0))
        .when(layer == 4, F.bround(1 - distance / F.lit(64.0), 4))
    )


def cluster_items(
    signatures: DataFrame,
    stored: DataFrame | None = None,
    stored_membership: DataFrame | None = None,
    stored_clusters: DataFrame | None = None,
    rules: ClusterRules | None = None,
    matched: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """``(item_id, cluster_key, matched_by, similarity, is_seed)`` for the new items.

    Without stored tables this is a full build. In incremental mode ``stored``
    are candidate signatures, ``stored_membership(item_id, cluster_key)`` their
    clusters and ``stored_clusters(cluster_key)`` every existing cluster, which
    an unmatched item joins by key whatever its age or status. What
    :func:`match_items` gave for the same tables may be handed in as ``matched``.
    """
    rules = rules or ClusterRules()
    sig, matches = matched or match_items(signatures, stored, rules)
    new = sig.filter("fresh = 1")
    keyed = new.select(
        "ord",
        F.coalesce("entity_key", fallback_key(F.col("url_hash"))).alias("own_key"),
    )
    lone = keyed.join(matches.select("ord"), "ord", "left_anti")
    # Unmatched items with one key gather at the first of them.
    heads = lone.groupBy("own_key").agg(F.min("ord").alias("head"))
    known = None
    if stored_clusters is not None:
        known = stored_clusters.select(F.col("cluster_key").alias("own_key")).distinct()
    edges = matches.select("ord", F.col("parent").alias("ptr")).unionByName(
        lone.join(heads, "own_key").select("ord", F.col("head").alias("ptr"))
    )
    if stored is not None:
        edges = edges.unionByName(sig.filter("fresh = 0").select("ord", F.col("ord").alias("ptr")))
    roots = resolve_roots(edges)
    named = keyed.select(F.col("ord").alias("root"), F.col("own_key").alias("root_key"))
    if stored is not None:
        carried = (
            sig.filter("fresh = 0")
            .select("ord", "item_id")
            .join(stored_membership.select("item_id", "cluster_key"), "item_id")
            .select(F.col("ord").alias("root"), F.col("cluster_key").alias("root_key"))
        )
        named = named.unionByName(carried)
    seeds = lone.join(heads, "own_key").filter(F.col("ord") == F.col("head")).select("ord", "own_key")
    if known is not None:
        seeds = seeds.join(known, "own_key", "left_anti")
    seeds = seeds.select("ord", F.lit(True).alias("seed"))
    return (
        new.select("ord", "item_id")
        .join(roots, "ord")
        .join(named, "root")
        .join(matches, "ord", "left")
        .join(seeds, "ord", "left")
        .select(
            "item_id",
            F.col("root_key").alias("cluster_key"),
            F.coalesce(
                F.element_at(
                    F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair]),
                    F.col("layer"),
                ),
                F.lit("SEED"),
            ).alias("matched_by"),
            similarity(F.col("layer"), F.col("distance")).alias("similarity"),
            F.coalesce("seed", F.lit(False)).alias("is_seed"),
        )
    )


def resolve_roots(edges: DataFrame) -> DataFrame:
    """``(ord, root)`` of a parent forest ``(ord, ptr)`` by pointer doubling.

    Each round halves the remaining depth; settled nodes leave the loop. The
    only thing the driver sees is whether any node is still moving.
    """
    current = materialize(edges, "forest")
    settled: DataFrame | None = None
    while True:
        parents = current.select(F.col("ord").alias("ptr"), F.col("ptr").alias("next"))
        if settled is not None:
            parents = parents.unionByName(
                settled.select(F.col("ord").alias("ptr"), F.col("root").alias("next"))
            )
        stepped = materialize(
            current.join(parents, "ptr").select(
                "ord", F.col("next").alias("ptr"), (F.col("ptr") == F.col("next")).alias("done")
            ),
            "forest",
        )
        done = stepped.filter("done").select("ord", F.col("ptr").alias("root"))
        settled = done if settled is None else settled.unionByName(done)
        current = stepped.filter("not done").select("ord", "ptr")
        if current.isEmpty():
            return settled


# ------------------------------------------------------------- aggregates


def trust_order(trust: Column) -> Column:
    return F.element_at(
        F.create_map(*[F.lit(x) for pair in TRUST_ORDER.items() for x in pair]), trust
    )


def cluster_table(members: DataFrame, items: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row per cluster.

    Vendor, product, version, event and summary are the seed's. The primary
    item, and with it the title, moves to the first item whose trust exceeds
    everything before it, which is the earliest of those with the highest trust.
    """
    facts = (
        members.select("cluster_key", "item_id")
        .join(items.select("item_id", "trust", "published_at", "discovered_at"), "item_id")
        .withColumn("level", trust_order(F.col("trust")))
    )
    order = F.struct("discovered_at", "item_id")
    seed = F.struct(
        F.col("item_id").alias("seed_item_id"),
        F.coalesce("published_at", "discovered_at").alias("event_at"),
        F.col("discovered_at").alias("first_seen_at"),
    )
    primary = F.struct(F.col("item_id").alias("primary_item_id"), F.col("trust").alias("max_trust"))
    # Texts stay out of the aggregation and are looked up for the chosen items.
    chosen = (
        facts.groupBy("cluster_key")
        .agg(
            F.min_by(seed, order).alias("seed"),
            F.min_by(primary, F.struct(-F.col("level"), "discovered_at", "item_id")).alias(
                "primary"
            ),
            F.max("discovered_at").alias("last_seen_at"),
            F.count("*").alias("item_count"),
        )
        .select("cluster_key", "seed.*", "primary.*", "last_seen_at", "item_count")
    )
    of_seed = signatures.select(
        F.col("item_id").alias("seed_item_id"), "vendor", "product", "version", "event_type", "simhash"
    ).join(
        items.select(F.col("item_id").alias("seed_item_id"), F.col("summary").alias("canonical_summary")),
        "seed_item_id",
    )
    of_primary = items.select(
        F.col("item_id").alias("primary_item_id"), F.col("title").alias("canonical_title")
    )
    return (
        chosen.join(of_primary, "primary_item_id")
        .join(of_seed, "seed_item_id")
        .withColumn("status", F.lit("OPEN"))
        .withColumn("needs_rescore", F.lit(True))
    )


def cluster_members(members: DataFrame) -> DataFrame:
    """Membership rows; only a seed is ever recorded as PRIMARY."""
    return members.select(
        "cluster_key",
        "item_id",
        F.when(F.col("is_seed"), "PRIMARY").otherwise("SUPPORTING").alias("role"),
        "matched_by",
        "similarity",
    )


def merge_clusters(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """New version of the cluster table after an incremental run.

    A stored cluster keeps its identity fields; count, last sighting and, when
    the newcomers are more trusted, title and primary item move on.
    """
    fresh = incoming.select(*[F.col(c).alias(f"n_{c}") for c in incoming.columns])
    joined = current.join(fresh, F.col("cluster_key") == F.col("n_cluster_key"), "full")
    stronger = F.coalesce(
        trust_order(F.col("n_max_trust")) > trust_order(F.col("max_trust")), F.lit(False)
    )
    seed_fields = [
        "seed_item_id", "event_type", "canonical_summary", "vendor", "product", "version",
        "simhash", "event_at", "first_seen_at",
    ]
    exists = F.col("cluster_key").isNotNull()
    return joined.select(
        F.coalesce("cluster_key", "n_cluster_key").alias("cluster_key"),
        *[F.when(exists, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c) for c in seed_fields],
        *[
            F.when(exists & ~stronger, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c)
            for c in ("primary_item_id", "canonical_title", "max_trust")
        ],
        F.greatest("last_seen_at", "n_last_seen_at").alias("last_seen_at"),
        (
            F.coalesce("item_count", F.lit(0)) + F.coalesce("n_item_count", F.lit(0))
        ).alias("item_count"),
        F.coalesce("status", F.lit("OPEN")).alias("status"),
        (F.coalesce("needs_rescore", F.lit(False)) | F.col("n_cluster_key").isNotNull()).alias(
            "needs_rescore"
        ),
    )


def candidate_window(
    items: DataFrame, now: str, days: int = CANDIDATE_DAYS, limit: int | None = None
) -> DataFrame:
    """Already clustered items discovered within the window; newest ``limit`` if asked."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    recent = items.filter((F.col("status") != "NEW") & (F.col("discovered_at") >= since))
    if limit is None:
        return recent
    return recent.orderBy(F.desc("discovered_at"), "item_id").limit(limit)


def pending_items(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items waiting to be clustered; oldest ``limit`` if asked."""
    pending = items.filter(F.col("status") == "NEW")
    return pending if limit is None else pending.orderBy("discovered_at", "item_id").limit(limit)


def match_statistics(members: DataFrame) -> DataFrame:
    """Items and created clusters per match method."""
    return members.groupBy("matched_by").agg(
        F.count("*").alias("items_attached"), F.count_if("is_seed").alias("clusters_created")
    )


#: Values of one block of either side; two blocks are compared in one cell.
_BLOCK = 8192
#: Tasks that the cells are dealt over at most.
_CELL_TASKS = 1024


def near_any(asking: DataFrame, archive: DataFrame, max_distance: int, block: int = _BLOCK) -> DataFrame:
    """``value`` of ``asking(value)`` with a value of ``archive(value)`` within the distance.

    For wide radii, where bands are too short to keep pairs apart: both sides are
    dealt into blocks of about ``block`` values, each block meets each of the
    other side in a cell, and cells are spread over tasks by number, not by their
    few bytes. A value stops at its first near one, no pair is written, and a task
    holds a few blocks. The comparisons grow with the product of both sides.
    """
    asking, archive = materialize(asking.select("value").distinct(), "asked-values"), materialize(
        archive.select("value").distinct(), "archive-values"
    )
    asked, held = (max(1, -(-side.count() // block)) for side in (asking, archive))
    tasks = min(asked * held, _CELL_TASKS)

    def dealt(side: DataFrame, own: int, cell: Callable[[Column, Column], Column], others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("value"), F.lit(own))
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint")))
        rows = side.select("value", mine.alias("mine"), other.alias("other"))
        return rows.select("value", cell(F.col("mine"), F.col("other")).alias("cell")).repartition(tasks, "cell")

    left = dealt(asking, asked, lambda mine, other: mine * held + other, held).alias("l")
    right = dealt(archive, held, lambda mine, other: other * held + mine, asked).alias("r")
    near = F.bit_count(F.col("l.value").bitwiseXOR(F.col("r.value"))) <= max_distance
    return left.join(right.hint("shuffle_hash"), (F.col("l.cell") == F.col("r.cell")) & near, "left_semi").select("value").distinct()


def similar_to_published(
    clusters: DataFrame, published: DataFrame, max_distance: int = 12
) -> DataFrame:
    """Flag clusters whose wording is close to something already published.

    What is published itself is close; of the rest, distinct values meet the
    archive's distinct values. A cluster without a value is not close.
    """
    values = published.select("simhash").filter(F.col("simhash").isNotNull()).distinct()
    asking = clusters.select("simhash").filter(F.col("simhash").isNotNull()).join(values, "simhash", "left_anti")
    value = F.col("simhash").alias("value")
    near = near_any(asking.select(value), values.select(value), max_distance).select(F.col("value").alias("simhash"))
    flagged = near.union(values).distinct().withColumn("similar_to_published", F.lit(True))
    return clusters.join(flagged, "simhash", "left").withColumn(
        "similar_to_published", F.coalesce("similar_to_published", F.lit(False))
    )
