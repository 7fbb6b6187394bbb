"""What the operators share: reading tables, text buffers of Arrow columns, hashing, components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from nichelens.session import discard, materialize, ship

#: Characters that end a word: all of ASCII but digits and letters. Words are runs of anything else.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: For bytes: A-Z to lower case, what ends a word to a blank, all else as it is.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: For bytes: A-Z to lower case only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the split into training and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """Whether the row is kept out of training; a row without an id counts as held out."""
    return F.coalesce(bucket(doc_id, parts) == rest, F.lit(True))


def with_id(kind: DataType, rest: str) -> StructType:
    """Schema of a column ``id`` of the given type, followed by the columns of a DDL text."""
    return StructType([StructField("id", kind), *StructType.fromDDL(rest).fields])


def slices(batches, limit: int = 4 << 20, column: int | str = "text"):
    """Arrow batches cut so that the texts of one hold about ``limit`` bytes (one text may hold more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(
            pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64
        )
        group = np.cumsum(lengths) // limit
        starts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b > a:
                yield batch.slice(int(a), int(b - a))


def release() -> None:
    """Give memory that a worker no longer uses back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A function over Arrow batches that gives its worker's unused memory back when a task ends."""

    def over(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return over


def texts_of(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of an edge.

    Alternates large-star and small-star steps; each round is written to the shared folder, so no
    lineage builds up, and only "did anything change" reaches the driver. Every step groups edges by
    a node with map-side minima, and joins by node, which Spark may split where a node is hot.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs, "edges")
    # Equal tables have equal numbers of rows and sums of hashes; a step that changes nothing is the last.
    digest = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")))
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        low = low.select("u", F.least("u", "low").alias("low"))
        # Large star: every larger neighbour of u is tied to the least node around u.
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        )
        # Small star: u (the larger end) and its smaller neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        tied = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = materialize(tied.union(low.select("u", F.col("low").alias("v"))).distinct(), "small")
        discard(pairs)
        pairs, now = small, small.agg(*digest).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


_SEPARATORS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Words of a text as JVM expressions: separators cut, A-Z lower-cased; null and blank texts have none.

    ``lower`` also folds other letters, which changes no word boundary; the one sign that it would turn
    into an ASCII letter (the kelvin sign) is replaced before.
    """
    folded = F.lower(F.replace(text, F.lit("K"), F.lit("�")))
    trimmed = F.btrim(F.coalesce(folded, F.lit("")), F.lit(_SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))
