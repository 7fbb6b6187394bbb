"""Substrings found through posting lists of three-character grams.

A text that contains a string contains all its grams. Searches read the posting
lists of the rarest grams of what is sought and verify the few texts that hold
all of them; terms of a lexicon meet texts by the one gram of each term that
the fewest texts hold. Neither puts one condition per term into a plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelens.functions.lexicon import Lexicon, _clamp
from nichelens.session import materialize
from nichelens.sources.sinks import BUCKET, key_bucket

GRAM = 3
#: Posting lists that a search intersects.
RAREST = 4


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct runs of ``size`` characters; a shorter text, or NULL, has none."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


# ------------------------------------------------------------------ searches


def write_search_index(rows: DataFrame, path: str, id_col: str, text_cols: Sequence[str], buckets: int = 32) -> None:
    """Posting lists, their lengths, and the rows themselves, each in buckets.

    ``postings(gram, id)`` and ``lengths(gram, n)`` are bucketed by gram and sorted
    by it, ``rows`` by id. A gram that most rows hold is split over several files.
    """
    held = F.array_distinct(F.flatten(F.array(*[grams(F.lower(F.col(c))) for c in text_cols])))
    postings = rows.select(F.col(id_col), F.explode(held).alias("gram"))
    # A text is cut once: what is written is read again for the lengths.
    placed = postings.withColumn(BUCKET, key_bucket(["gram"], buckets)).hint("rebalance", BUCKET)
    placed.sortWithinPartitions(BUCKET, "gram").write.partitionBy(BUCKET).parquet(f"{path}/postings")
    lengths = rows.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    lengths.withColumn(BUCKET, key_bucket(["gram"], buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/lengths")
    rows.withColumn(BUCKET, key_bucket([id_col], buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/rows")


def literal_parts(pattern: str) -> list[str]:
    """What a LIKE pattern requires literally: the text between its wildcards."""
    parts, held, signs = [], "", iter(pattern)
    for c in signs:
        if c == "\\":
            held += next(signs, "")
        elif c in "%_":
            parts.append(held)
            held = ""
        else:
            held += c
    return [p for p in [*parts, held] if p]


def _required(spark: SparkSession, pattern: str) -> list[str]:
    parts = literal_parts(pattern)
    found = spark.range(1).select(F.array_distinct(F.flatten(F.array(*[grams(F.lower(F.lit(p))) for p in parts or [""]]))))
    return found.first()[0]


def _of_grams(spark: SparkSession, path: str, wanted: Sequence[str], buckets: int) -> DataFrame:
    """Rows of a table by gram, reading the buckets of the wanted grams only."""
    spots = spark.createDataFrame([(g,) for g in wanted], "gram string").select(key_bucket(["gram"], buckets)).distinct()
    numbers = [r[BUCKET] for r in spots.collect()]
    return spark.read.parquet(path).filter(F.col(BUCKET).isin(numbers) & F.col("gram").isin(list(wanted))).drop(BUCKET)


def candidates(spark: SparkSession, path: str, id_col: str, query: str, buckets: int = 32) -> DataFrame | None:
    """Ids of rows that hold the rarest grams of ``query``; None if it has no gram to look up."""
    wanted = _required(spark, query)
    if not wanted:
        return None
    lengths = sorted((r["n"], r["gram"]) for r in _of_grams(spark, f"{path}/lengths", wanted, buckets).collect())
    if len(lengths) < len(wanted):  # a gram that no row holds
        return spark.read.parquet(f"{path}/rows").select(id_col).limit(0)
    rarest = [g for _, g in lengths[:RAREST]]
    postings = _of_grams(spark, f"{path}/postings", rarest, buckets)
    return postings.groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select(id_col)


def search(
    spark: SparkSession, path: str, id_col: str, text_cols: Sequence[str], query: str, buckets: int = 32
) -> DataFrame:
    """Indexed rows with ``query`` in one of the texts, by case-insensitive LIKE between two ``%``.

    A query without three literal characters in a row has no gram, and is
    answered by reading all rows; any other reads posting lists of at most
    ``RAREST`` grams, and the row buckets in which their common ids lie.
    """
    rows = spark.read.parquet(f"{path}/rows")
    ids = candidates(spark, path, id_col, query, buckets)
    if ids is not None:
        ids = materialize(ids, "search-candidates")
        spots = [r[BUCKET] for r in ids.select(key_bucket([id_col], buckets)).distinct().collect()]
        rows = rows.filter(F.col(BUCKET).isin(spots)).join(ids, id_col, "left_semi")
    fits = F.lit(False)
    for c in text_cols:
        fits = fits | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return rows.filter(fits).drop(BUCKET)


# ------------------------------------------------------------------ lexicons


def term_table(spark: SparkSession, lists: dict[str, dict[str, float]]) -> DataFrame:
    """``(list, position, term, weight)`` of weighted terms."""
    rows = [(name, i, term, float(w)) for name, terms in lists.items() for i, (term, w) in enumerate(terms.items())]
    return spark.createDataFrame(rows, "list string, position int, term string, weight double")


def matched_terms(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, list, total, terms)``: terms of each list that a text contains, in order of position.

    ``terms(list, position, term, weight)`` is a table of any length. Texts and
    terms meet by the gram of each term that the fewest texts hold; terms of one
    or two characters are grams themselves. Texts without a term of a list have
    no row; empty terms and NULLs match nothing. Each id stands for one text.
    """
    terms = terms.filter(F.length("term") > 0)
    shortest = terms.agg(F.min(F.length("term"))).first()[0]
    sizes = range(min(shortest or GRAM, GRAM), GRAM + 1)
    held = F.explode(F.flatten(F.array(*[grams(F.col(text_col), n) for n in sizes]))).alias("gram")
    size = F.least(F.length("term"), F.lit(GRAM))
    pieces = F.filter(F.flatten(F.array(*[grams(F.col("term"), n) for n in sizes])), lambda g: F.length(g) == size)
    spelled = terms.select("list", "position", "term", "weight", F.explode(pieces).alias("gram"))
    inside = texts.select(id_col, held).join(spelled.select("gram").distinct(), "gram", "left_semi")
    inside = materialize(inside, "text-grams")
    holders = inside.groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = F.min_by("gram", F.struct("texts", "gram")).alias("gram")
    # A term one of whose grams is in no text is in none.
    known = spelled.join(holders, "gram", "left")
    anchors = known.groupBy("list", "position", "term", "weight").agg(rarest, F.bool_and(F.col("texts").isNotNull()).alias("all"))
    anchors = anchors.filter("all").drop("all")
    asked = inside.join(anchors, "gram").groupBy(id_col, "list").agg(F.collect_list(F.struct("position", "term", "weight")).alias("asked"))
    found = asked.join(texts.select(id_col, text_col), id_col).select(
        id_col, "list", F.array_sort(F.filter("asked", lambda x: F.contains(F.col(text_col), x["term"]))).alias("found")
    )
    return found.filter(F.size("found") > 0).select(
        id_col, "list",
        F.aggregate("found", F.lit(0.0), lambda acc, x: acc + x["weight"]).alias("total"),
        F.transform("found", lambda x: x["term"]).alias("terms"),
    )


def relevance_by_table(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, lexicon: Lexicon) -> DataFrame:
    """``(id, value, matched, penalised)``: relevance by the lists ``positive`` and ``negative`` of ``terms``.

    Bases and limits are the lexicon's; its own terms are not read.
    """
    found = matched_terms(texts, terms, id_col, text_col)
    sides = found.groupBy(id_col).pivot("list", ["positive", "negative"]).agg(
        F.first("total").alias("total"), F.first("terms").alias("terms")
    )
    none = F.array().cast("array<string>")
    plus, minus = (F.coalesce(F.col(f"{x}_total"), F.lit(0.0)) for x in ("positive", "negative"))
    value = F.lit(lexicon.relevance_base) + F.least(plus, F.lit(lexicon.max_positive)) - F.least(minus, F.lit(lexicon.max_negative))
    return texts.select(id_col).join(sides, id_col, "left").select(
        id_col, _clamp(value).alias("value"),
        F.coalesce("positive_terms", none).alias("matched"), F.coalesce("negative_terms", none).alias("penalised"),
    )
