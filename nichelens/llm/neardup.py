"""Near duplicates by DartMinHash: word shingles, sparse weighted signatures, banded joining.

A document is its set of five-word shingles (all its words as one shingle if it has fewer); with
``counted`` it is the multiset. Every element owns a region of its weight; darts fall on it as a Poisson
process in rank, from a hash of the element alone, and each dart names a coordinate. Only darts up to a
rank that a document of its weight needs are thrown, about k log k + 2k in all whatever its length; the
earliest dart of each coordinate gives the signature, so two documents agree in a coordinate with the
probability of their (weighted) Jaccard similarity. Documents short of a coordinate throw further.

With ``BANDS`` bands of ``ROWS`` coordinates a pair of similarity 0.8 is missed with probability 7e-6.
Links are then decided by the exact similarity of the shingle sets (of 64-bit hashes).

Groups of copies are never paired among themselves. Documents of equal sets become one node first. In a
round every bucket of equal bands has a leader, and each node is compared with one leader of another
component, whose buckets it shares; what a round links is one component from then on. The first round is
led by the nodes that share most buckets with others, such as the text that all near copies of a group were
made from: those are near to it, though few are near to each other. Rounds with other leaders go on while they link. At the end only nodes of *different* components that share a
bucket are compared, all of them that may reach the similarity, so no link between components is lost: in buckets of at
most ``CROWD`` rows pair by pair, in larger ones by shared differences from one node of the bucket's largest
component, of which near ones must have many in common. What a node shares with any other is at most its elements that are not its own alone: texts that have a long passage
in common and else a rest of their own are told apart by these numbers, before any set is looked at.

Result: one row per row, with the class id: the least id of the component. Documents without words, and
null texts, are classes of their own; without an id the class is null. Rows of one id are one document.
Ids are integers; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelens.llm.common import FOLD, components, mix64, slices, texts_of, tidy
from nichelens.session import discard, materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
#: Nodes of a bucket above which they are no longer paired one with another.
CROWD = 32
#: The least of node XOR one of these is a bucket's leader in a round; XOR again gives the node.
ORDERS = (0, -1, 0x2492492492492492, 0x5A5A5A5A5A5A5A5A, 0x0F0F33335555AAAA, 0x1234567890ABCDEF)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GOLD, _SALT = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            line = np.full(size, base)
            line[0] = 1
            _POWERS[name] = np.cumprod(line)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every shingle of every text, in text order."""
    flat = np.frombuffer(b" ".join([t.translate(FOLD) for t in texts]) + b" ", dtype=np.uint8)
    up, down = _powers(len(flat) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    inside = flat != 32
    edge = np.flatnonzero(np.diff(np.concatenate((np.zeros(1, np.int8), inside.view(np.int8)))))
    starts, ends = edge[::2], edge[1::2]
    words = mix64((sums[ends] - sums[starts]) * down[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(bounds, starts, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    here = np.minimum(counts, size)  # words of a shingle of this text
    place = np.arange(len(words)) - first[owner]
    begins = np.flatnonzero(place <= counts[owner] - here[owner])
    value = np.zeros(len(begins), dtype=np.uint64)
    for j in range(size):
        part = j < here[owner[begins]]
        at = np.minimum(begins + j, len(words) - 1)
        value = np.where(part, mix64(value * _BASE + words[at] + np.uint64(j)), value)
    return owner[begins], value


def element_sets(texts: list[bytes], size: int = SHINGLE, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(owner, element) with each element once: sorted by owner and element. Counted: one for each level."""
    owner, value = shingle_hashes(texts, size)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(owner):
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
        if counted:
            run = np.arange(len(owner))
            level = run - np.maximum.accumulate(np.where(new, run, 0))
            value = np.where(level > 0, mix64(value + level.astype(np.uint64) * _GOLD), value)
        else:
            owner, value = owner[new], value[new]
    return owner, value


def dart_signatures(owner: np.ndarray, value: np.ndarray, count: int, k: int) -> np.ndarray:
    """(count, k) signatures: the element of the earliest dart of each coordinate."""
    weight = np.bincount(owner, minlength=count)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    signature = np.zeros((count, k), dtype=np.uint64)
    todo = weight > 0
    while todo.any():
        live = todo[owner]
        doc, element = owner[live], value[live]
        state, rank = mix64(element + _SALT), np.zeros(len(doc))
        keys, ranks, elements = [], [], []
        while len(doc):
            state = mix64(state + _GOLD)
            rank = rank - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            keep = rank <= limit[doc]
            doc, element, state, rank = doc[keep], element[keep], state[keep], rank[keep]
            coordinate = mix64(state ^ _SALT) % np.uint64(k)
            keys.append(doc * k + coordinate.astype(np.int64))
            ranks.append(rank)
            elements.append(element)
        key, rank, element = np.concatenate(keys), np.concatenate(ranks), np.concatenate(elements)
        earliest = np.full(count * k, np.inf)
        np.minimum.at(earliest, key, rank)
        won = rank == earliest[key]
        flat = signature.reshape(-1)
        flat[key[won]] = element[won]
        todo = todo & ~np.isfinite(earliest.reshape(count, k)).all(axis=1)
        limit = limit * 2
    return signature


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(count, bands) hashes of ``rows`` coordinates each, told apart by the band's number."""
    shaped = signature.reshape(len(signature), bands, rows)
    value = np.broadcast_to(np.arange(bands, dtype=np.uint64) + _SALT, shaped.shape[:2])
    for j in range(rows):
        value = mix64(value * _BASE + shaped[:, :, j])
    return value


def sign(docs: DataFrame, bands: int, rows: int, size: int, counted: bool) -> DataFrame:
    """(id, k1, k2, n, bands): a 128-bit hash and the number of a document's elements, and its bands."""

    def run(batches):
        for part in slices(batches, 1 << 20):
            texts = texts_of(part.column("text"))
            owner, value = element_sets(texts, size, counted)
            n = np.bincount(owner, minlength=len(texts))
            some = np.flatnonzero(n)
            if not len(some):
                continue
            starts = (np.cumsum(n) - n)[some]
            k1 = np.add.reduceat(mix64(value ^ _SALT), starts)
            k2 = np.add.reduceat(mix64(value + _GOLD), starts)
            hashed = bands_of(dart_signatures(owner, value, len(texts), bands * rows)[some], bands, rows)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(hashed.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(some)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n[some], pa.int64()), lists],
                names=["id", "k1", "k2", "n", "bands"],
            )

    return docs.mapInArrow(tidy(run), "id long, k1 long, k2 long, n long, bands array<long>")


def sets_of(docs: DataFrame, size: int, counted: bool) -> DataFrame:
    """(id, elements array<long>) of whole texts."""

    def run(batches):
        for part in slices(batches, 1 << 20):
            texts = texts_of(part.column("text"))
            owner, value = element_sets(texts, size, counted)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "elements"])

    return docs.mapInArrow(tidy(run), "id long, elements array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return pairs.join(left, "a").join(right, "b").where(shared >= similarity * union).select("a", "b").distinct()


def _differences(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, pivot, own, n, n_p, near, d) of pairs (node, pivot, own): the elements d that only one of the two has,
    and whether both reach the threshold. A pivot of several sets is one of them; a node of several has a row for each."""
    left = sets.select("node", F.col("elements").alias("x"))
    right = sets.join(pairs.select(F.col("pivot").alias("node")).distinct(), "node", "left_semi")
    right = right.groupBy(F.col("node").alias("pivot")).agg(F.min("elements").alias("y"))
    d = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    found = pairs.join(left, "node").join(right, "pivot").select("node", "pivot", "own", F.size("x").alias("n"), F.size("y").alias("n_p"), d.alias("d"))
    shared = (F.col("n") + F.col("n_p") - F.size("d")) / 2
    return found.withColumn("near", shared >= similarity * (F.col("n") + F.col("n_p") - shared))


def _by_differences(apart: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components (``root``) that may reach the threshold, of nodes compared with one pivot.

    Sets x and y of n and m elements are near if at most K (n + m) elements are in one only, K = (1 - s) / (1 + s).
    With X and Y their differences from the pivot of p elements, they have |X| + |Y| - 2 |X and Y| such elements.
    One of two components is not near to the pivot: |X| > K (n + p). So near ones have over (|Y| + K (p - m)) / 2
    differences in common, and, as |Y| >= |m - p|, at least (|X| - K (n + p)) / 2. Of two sets with at least t
    elements in common, the size - t + 1 first ones in any order have one in common; rarest come first. At the
    first one that they have in common, what follows in both must be enough for the rest. At least ``own`` elements
    of a node are known to be in no other.
    """
    share = (1 - similarity) / (1 + similarity)
    size, n, n_p = F.col("size"), F.col("n"), F.col("n_p")
    rows = apart.withColumns({"size": F.size("d"), "key": F.xxhash64("n", "d")})
    least_a, least_b = F.ceil((size - share * (n + n_p)) / 2 - 1e-9), F.floor((size + share * (n_p - n)) / 2) + 1
    spare = size - F.col("own")
    rows = rows.where((spare >= least_b) | (~F.col("near") & (spare >= least_a)))
    rows = rows.join(rows.where("NOT near").select("pivot").distinct(), "pivot", "left_semi")
    each = rows.select("node", "pivot", "key", F.explode("d").alias("e"))
    several = each.groupBy("pivot", "e").agg(F.count("*").alias("many")).where("many > 1")
    listed = each.join(several, ["pivot", "e"]).groupBy("node", "pivot", "key").agg(F.sort_array(F.collect_list(F.struct("many", "e"))).alias("known"))
    rows = rows.drop("d").join(listed, ["node", "pivot", "key"])
    common = F.size("known")

    def met(least: Column) -> Column:
        """The elements by which a node is met that has at least so many in common with another."""
        first = size - least + 1 - (size - common)
        return F.posexplode(F.slice("known", 1, F.greatest(F.least(first, common), F.lit(0)).cast("int"))["e"]).alias("at", "e")

    kept = ("node", "root", "n", "size", common.alias("common"))
    a = rows.where("NOT near").select("pivot", met(least_a), *kept)
    b = rows.select("pivot", met(least_b), *kept)
    a = a.select("pivot", "e", *[F.col(c).alias(f"{c}_a") for c in a.columns[3:]], (F.col("common") - F.col("at")).alias("left_a"))
    b = b.select("pivot", "e", *b.columns[3:], (F.col("common") - F.col("at")).alias("left"))
    enough = F.least("left", "left_a") >= (F.col("size_a") + size - share * (F.col("n_a") + n)) / 2 - 1e-9
    return a.join(b, ["pivot", "e"]).where("root <> root_a").where(enough).select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()


def classes(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, counted: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, class_id) of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = source.where("id IS NOT NULL AND text IS NOT NULL")
    signed = materialize(sign(known, bands, rows, size, counted), "signatures")
    same = signed.groupBy("k1", "k2", "n").agg(F.min("id").alias("node"))
    member = signed.select("id", "k1", "k2", "n", "bands").join(same, ["k1", "k2", "n"])
    buckets = member.where("id = node").select("node", "n", F.explode("bands").alias("band"))
    several = buckets.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    buckets = materialize(buckets.join(several.select("band"), "band").distinct(), "buckets")
    member = materialize(member.select("id", "node"), "members")
    discard(signed)
    crowd = buckets.select("node").distinct()
    # Sets of the nodes that share a bucket with another; the small side is hashed, texts are not sorted.
    wanted = known.join(crowd.select(F.col("node").alias("id")).hint("shuffle_hash"), "id", "left_semi")
    sets = materialize(sets_of(wanted, size, counted).select(F.col("id").alias("node"), "elements"), "sets")

    def mixed(rest: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Of bucket rows those in buckets that hold several components still, each with its component."""
        if roots is not None:
            rest = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        else:
            rest = rest.withColumn("root", F.col("node"))
        several = rest.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        return materialize(rest.join(several.select("band"), "band"), "mixed")

    def fits(n: tuple[str, str], shared: tuple[str, str]) -> Column:
        """Whether the sizes, and the numbers of elements that others have too, allow the similarity at all."""
        most = F.least(*shared)
        return most >= similarity * (F.col(n[0]) + F.col(n[1]) - most)

    def central(rest: DataFrame) -> DataFrame:
        """Bucket rows with a rank, the lower the more a node shares buckets."""
        crowds = rest.join(rest.groupBy("band").count(), "band").groupBy("node").agg((-F.sum("count")).alias("rank"))
        return rest.join(crowds, "node")

    # Elements of one node only are in no intersection. A node of several sets is taken to have none.
    single = sets.select("node", F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("many"), F.min("node").alias("node"))
    alone = sets.groupBy("node").count().where("count = 1")
    single = single.where("many = 1").groupBy("node").agg(F.count("*").alias("own")).join(alone, "node", "left_semi")
    able = buckets.join(single, "node", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    rest = mixed(able.where(F.col("common") >= similarity * F.col("n")), None)

    roots: DataFrame | None = None

    def with_links(found: DataFrame, roots: DataFrame | None) -> tuple[DataFrame | None, bool]:
        """Components after the links (a, b) between nodes, and whether there were any."""
        if roots is None:
            edges = found
        else:
            # Known components count as one node each, their root.
            of_a, of_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
            edges = found.join(of_a, "a", "left").join(of_b, "b", "left")
            edges = edges.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        edges = materialize(edges.distinct(), "links")
        if edges.isEmpty():
            return roots, False
        merged = materialize(components(edges, "a", "b"), "roots")
        if roots is None:
            return merged, True
        moved = roots.withColumnRenamed("root", "old").join(
            merged.select(F.col("node").alias("old"), F.col("root").alias("new")), "old", "left"
        )
        moved = moved.select("node", F.coalesce("new", "old").alias("root"))
        return materialize(moved.union(merged.join(roots.select("node"), "node", "left_anti")), "roots"), True

    for order in (None, *ORDERS):
        ranked = rest
        if order is None:
            ranked = central(rest)
        else:
            ranked = rest.withColumn("rank", F.col("node").bitwiseXOR(F.lit(order)))
        leader = F.struct("rank", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("common").alias("common_a"))
        led = ranked.groupBy("band").agg(F.min(leader).alias("l")).select("band", "l.*")
        pairs = rest.join(led, "band").where("root <> root_a").where(fits(("n", "n_a"), ("common", "common_a")))
        one = pairs.groupBy(F.col("node").alias("b")).agg(F.min(F.struct("rank", "a")).alias("l")).select("l.a", "b")
        roots, linked = with_links(_verified(one, sets, similarity), roots)
        if linked:
            before, rest = rest, mixed(rest.drop("root"), roots)
            discard(before)
        elif order is not None:
            break
    mixed_rows = rest
    # What is still apart within a bucket. In small ones: all of the bucket's smaller components against all of it.
    held = rest.groupBy("band").count().withColumn("crowd", F.col("count") > CROWD).drop("count")
    rest = rest.join(held, "band")
    sized = rest.where("NOT crowd").groupBy("band", "root").count()
    main = sized.groupBy("band").agg(F.max(F.struct("count", "root")).alias("m")).select("band", F.col("m.root").alias("main"))
    whole = rest.where("NOT crowd").join(main, "band")
    minor = whole.where("root <> main").select(
        "band", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("common").alias("common_a")
    )
    pairs = minor.join(whole, "band").where("root <> root_a AND (root = main OR a < node)").where(fits(("n", "n_a"), ("common", "common_a")))
    found = _verified(pairs.select("a", F.col("node").alias("b")).distinct(), sets, similarity)
    # In large ones all are compared with one node of the bucket's largest component, the same in all its buckets,
    # and meet by what sets them apart from it.
    many = rest.where("crowd").drop("crowd")
    largest = many.groupBy("band", "root").count().groupBy("band").agg(F.max(F.struct("count", "root")).alias("m")).select("band", F.col("m.root").alias("root"))
    heads = central(many).groupBy("root").agg(F.min(F.struct("rank", "node")).alias("l")).select("root", F.col("l.node").alias("pivot"))
    faced = many.join(largest.join(heads, "root").select("band", "pivot"), "band").select("node", "pivot", (F.col("n") - F.col("common")).alias("own"))
    apart = materialize(_differences(faced.distinct(), sets, similarity), "differences")
    roots, _ = with_links(found.union(apart.where("near AND node <> pivot").select("pivot", "node")), roots)
    if roots is not None:
        apart_now = apart.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        apart_now = apart.withColumn("root", F.col("node"))
    roots, _ = with_links(_verified(_by_differences(apart_now, similarity), sets, similarity), roots)
    discard(apart)
    discard(buckets, sets, mixed_rows)

    found = member.select("id", "node")
    if roots is not None:
        found = found.join(roots, "node", "left").withColumn("node", F.coalesce("root", "node"))
    found = found.groupBy("id").agg(F.min("node").alias("class_id"))
    return docs.select(F.col(id_col), F.col(id_col).cast("long").alias("id__")).join(
        found.withColumnRenamed("id", "id__"), "id__", "left"
    ).select(id_col, F.coalesce("class_id", "id__").alias("class_id"))
