"""Document fingerprints: SimHash, in DataFrame expressions only.

Terms are neighbouring word pairs (the word itself in a text of one word); a term's weight is one, and
one more for each of its words of four letters or more, for every occurrence. Each bit of the term's
hash votes with the weight, signed; the fingerprint has the bits with a positive sum.

Votes are packed: ``(hash >> j) & 0x0001000100010001`` holds bits j, j+16, j+32, j+48 in lanes of 16
bits, so sixteen plain sums add up 64 votes. The uppermost lane has the sign and holds 32,767, a term weighs three
at most, so a text is summed in chunks of ``CHUNK`` terms, then by bit; texts of any length give exact sums, also
where one term makes up a whole chunk. Sums start within the map task.

Near fingerprints: the bits are cut into ``radius + 2`` blocks. Two fingerprints within the radius agree
in at least two blocks, so permuting each pair of blocks to the front gives tables in which an equality
join finds every such pair; a pair is reported by the first table in which it agrees.

Null and blank texts have no terms and the fingerprint of zeros. Each row gives one row, repeated rows
too. Ids must be numbers, near to unique; rows of equal id follow by text; rows without an id come first.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelens.llm.common import components, word_list
from nichelens.session import materialize

WORDS = 2
BITS = 64 * WORDS
#: Terms summed in one lane: with the largest weight, three, they stay below the sign.
CHUNK = 32_767 // 3
LANES = 0x0001000100010001
LONG_WORD = 4


def fingerprints(texts: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """(key..., fingerprint) where ``key`` tells rows apart; the text itself is not carried along."""
    words = texts.select(*key, word_list(F.col(text_col)).alias("words__"))
    at = words.select(*key, "words__", F.size("words__").alias("n__"), F.posexplode_outer("words__").alias("pos__", "word__"))
    follower = F.get("words__", F.col("pos__") + 1)
    is_term = F.col("pos__").isNotNull() & ((F.col("pos__") + 1 < F.col("n__")) | (F.col("n__") == 1))
    weight = (
        F.lit(1)
        + F.when(F.length("word__") >= LONG_WORD, 1).otherwise(0)
        + F.when(F.length(follower) >= LONG_WORD, 1).otherwise(0)
    )
    terms = at.select(
        *key,
        F.coalesce(F.floor(F.col("pos__") / CHUNK), F.lit(0)).cast("int").alias("chunk__"),
        F.when(is_term, weight).otherwise(0).cast("long").alias("w__"),
        F.xxhash64("word__", follower).alias("h0__"),
        *[F.xxhash64(F.lit(seed), "word__", follower).alias(f"h{seed}__") for seed in range(1, WORDS)],
    )
    packed = terms.groupBy(*key, "chunk__").agg(
        F.sum("w__").alias("total__"),
        *[
            F.sum(F.shiftrightunsigned(f"h{s}__", j).bitwiseAND(F.lit(LANES)) * F.col("w__")).alias(f"s{s}_{j}__")
            for s in range(WORDS)
            for j in range(16)
        ],
    )

    def votes(s: int, bit: int) -> Column:
        """Weight of the terms whose hash word ``s`` has the bit."""
        return F.sum(F.shiftrightunsigned(f"s{s}_{bit % 16}__", 16 * (bit // 16)).bitwiseAND(F.lit(0xFFFF)))

    summed = packed.groupBy(*key).agg(
        F.sum("total__").alias("total__"),
        *[votes(s, bit).alias(f"b{s}_{bit}__") for s in range(WORDS) for bit in range(64)],
    )

    def word(s: int) -> Column:
        bits = [F.when(2 * F.col(f"b{s}_{bit}__") > F.col("total__"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")) for bit in range(64)]
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
        return F.lpad(F.lower(F.hex(bits[0])), 16, "0")

    return summed.select(*key, F.concat(*[word(s) for s in range(WORDS)]).alias("fingerprint"))


def _parts(fingerprint: Column) -> list[Column]:
    """The 64-bit words of a fingerprint, as signed numbers."""
    return [F.conv(F.substring(fingerprint, 1 + 16 * s, 16), 16, -10).cast("long") for s in range(WORDS)]


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_parts(a), _parts(b), strict=True)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - distance(a, b) / F.lit(float(BITS))


def near(fingerprinted: DataFrame, radius: int = 6, column: str = "fingerprint") -> DataFrame:
    """(a, b, distance), a < b: every two different fingerprints that differ in ``radius`` bits or fewer.

    Documents of one fingerprint are one class here; join their ids to ``a`` and ``b``.
    """
    blocks = radius + 2
    if blocks > 16:
        raise ValueError("the radius must leave blocks of eight bits")
    cut = [round(i * BITS / 4 / blocks) for i in range(blocks + 1)]  # in hexadecimal digits
    each = fingerprinted.select(F.col(column).alias("f")).where("f IS NOT NULL").distinct()
    pairs = list(combinations(range(blocks), 2))

    def block(f: str, i: int) -> Column:
        return F.substring(f, 1 + cut[i], cut[i + 1] - cut[i])

    def tables(name: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(t).alias("t"), F.concat(block("f", i), block("f", j)).alias("k")) for t, (i, j) in enumerate(pairs)])
        return each.select(F.col("f").alias(name), F.explode(entries).alias("e")).select(name, "e.t", "e.k")

    joined = tables("a").join(tables("b"), ["t", "k"]).where((F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= radius))
    first = F.coalesce(*[F.when((block("a", i) == block("b", i)) & (block("a", j) == block("b", j)), t) for t, (i, j) in enumerate(pairs)])
    return joined.where(F.col("t") == first).select("a", "b", distance(F.col("a"), F.col("b")).alias("distance"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, place, id, text, next): each row with the text of the next one in order of id, the last
    with that of the first. ``bucket`` and ``place`` number the rows.

    Ids are cut into ranges at ids that exist, found by a bounded quantile sketch. The row on a cut also
    goes, as a guard, to the range before, so that each range is complete by itself and no window spans
    the whole table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    count = min(1000, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts, low, blanks = rows.agg(
        F.percentile_approx("id", [i / count for i in range(1, count)], 10_000), F.min("id"), F.count_if(F.col("id").isNull())
    ).first()
    cuts = sorted({c for c in cuts or () if c > low})
    kind = rows.schema["id"].dataType
    bounds = F.array(*[F.lit(c).cast(kind) for c in cuts]).cast(f"array<{kind.simpleString()}>")
    bucket = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col("id"))))
    entry = "array<struct<bucket:int,guard:int>>"

    def guard(when: Column, to: Column) -> Column:
        return F.when(when, F.array(F.struct(to.cast("int").alias("bucket"), F.lit(1).alias("guard")))).otherwise(F.array().cast(entry))

    very_first = F.col("id").isNull() if blanks else F.col("id") == F.lit(low).cast(kind)
    placed = rows.withColumn("b", bucket).withColumn(
        "to",
        F.concat(
            F.array(F.struct(F.col("b").cast("int").alias("bucket"), F.lit(0).alias("guard"))),
            guard((F.col("b") > 0) & F.array_contains(bounds, F.col("id")), F.col("b") - 1),
            guard(F.coalesce(very_first, F.lit(False)), F.lit(len(cuts))),
        ),
    )
    spread = placed.select("id", "text", F.explode("to").alias("to")).select("id", "text", "to.bucket", "to.guard")
    order = Window.partitionBy("bucket").orderBy("guard", F.col("id").asc_nulls_first(), F.md5(F.col("text").cast("binary")))
    ordered = spread.withColumn("next", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
    return ordered.where("guard = 0").drop("guard")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 6) -> DataFrame:
    """Each text's fingerprint beside those of its edited form and of the next document; ``n_near`` other
    fingerprints of documents lie within ``radius`` bits, and ``near_class`` is the least fingerprint that
    such steps lead to.

    The edited text ends in the next document's first code points instead of its own last quarter.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 4)))"), F.substring("next", F.lit(1), quarter))
    rows = rows.select(
        "bucket", "place", "id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"),
        F.md5(F.col("text").cast("binary")).alias("md5"), F.md5(F.col("next").cast("binary")).alias("next_md5"),
    )
    both = rows.select(
        "bucket", "place", "id", "n_chars", "md5", "next_md5",
        F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))),
    )
    key = ["bucket", "place", "id", "n_chars", "md5", "next_md5", "which", "sha"]
    hashed = both.withColumn("sha", F.when(F.col("which") == 1, F.sha2(F.col("t").cast("binary"), 256)))
    prints = fingerprints(hashed, key, "t")
    wide = prints.groupBy("bucket", "place", "id", "n_chars", "md5", "next_md5").agg(
        F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    wide = materialize(wide, "fingerprints")
    # Every fingerprint's near ones among all documents: how many there are, and the least of the group as its class.
    pairs = materialize(near(wide, radius), "near-fingerprints")
    both = pairs.select(F.col("a").alias("fingerprint"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    links = both.groupBy("fingerprint").agg(F.count("*").alias("n_near"))
    roots = components(pairs, "a", "b").select(F.col("node").alias("fingerprint"), F.col("root").alias("near_class"))
    linked = links.join(roots, "fingerprint")
    of_text = wide.select(F.col("md5").alias("next_md5"), F.col("fingerprint").alias("next_fingerprint")).distinct()
    return wide.join(of_text, "next_md5").join(linked, "fingerprint", "left").select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.coalesce("near_class", "fingerprint").alias("near_class"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
