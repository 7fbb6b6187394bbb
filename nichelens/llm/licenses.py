"""License scans by diagonal voting, in DataFrame expressions only.

Templates are word sequences: short phrases and the wording of license notices. Every rolling k-gram of
a document's words is joined by hash (and then by its words) to the template positions that hold it. A
match is a vote for a diagonal, document position minus template position. Votes are added up per
diagonal; of notices, neighbouring diagonals (words put in or left out) are merged, and a merged span
counts when enough of the template voted within it. A phrase counts where its one diagonal is complete.

Short templates use k = 2, notices k = 5, so that ordinary words cast no votes for notices. The
templates are part of the program, so the broadcast tables have a fixed size.

Null and blank texts have no words and no labels. Each input row gives one output row: equal rows (same
id, same text) are scanned together and multiplied again at the end. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nichelens.llm.common import word_list

SHORT_K, LONG_K = 2, 5
#: Diagonals of one notice at most so far apart, with at most so many words between, are one span.
SHIFT, GAP = 4, 12
#: Share of a notice's k-grams that must have voted.
LEAST_SHARE = 0.5


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False


# The phrases whose places are counted.
BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

# Phrases and notices that add labels.
MORE = (
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal"),
    Template("bsd", "bsd license"),
    Template("mpl", "mozilla public license"),
    Template("isc", "isc license"),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction including without limitation the rights to "
        "use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    Template(
        "apache-text",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    Template(
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    Template("cc-text", "this work is licensed under a creative commons attribution"),
)


def _gram_table(spark: SparkSession, templates: Sequence[tuple[int, list[str]]], k: int, name: str) -> DataFrame:
    """(hash, gram, votes): the template positions of each k-gram, as one row of literals."""
    at: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for number, words in templates:
        for i in range(len(words) - k + 1):
            at.setdefault(tuple(words[i : i + k]), []).append((number, i))
    rows = [
        F.struct(
            F.xxhash64(*[F.lit(w) for w in gram]).alias(f"{name}_hash"),
            F.lit(" ".join(gram)).alias(f"{name}_gram"),
            F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(k).alias("k")) for t, i in places]).alias(f"{name}_votes"),
        )
        for gram, places in at.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def scan(
    docs: DataFrame, base: Sequence[Template] = BASE, more: Sequence[Template] = MORE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists what was found: label, first word, last word, share of the template that voted.
    """
    spark = docs.sparkSession
    known = [(i, t, t.text.split()) for i, t in enumerate([*base, *more])]
    if any(len(words) < SHORT_K for _, _, words in known):
        raise ValueError("a template needs two words")
    size = {i: LONG_K if len(words) > 2 * LONG_K else SHORT_K for i, _, words in known}
    short = _gram_table(spark, [(i, w) for i, _, w in known if size[i] == SHORT_K], SHORT_K, "short")
    long = _gram_table(spark, [(i, w) for i, _, w in known if size[i] == LONG_K], LONG_K, "long")

    words = docs.select(
        F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("h"), word_list(F.col(text_col)).alias("words")
    ).withColumn("n_words", F.size("words"))
    at = words.select("id", "h", "n_words", "words", F.posexplode_outer("words").alias("pos", "word"))

    def gram(k: int) -> list[Column]:
        return [F.get("words", F.col("pos") + i) for i in range(k)]

    hashed = at.select(
        "id", "h", "n_words", "pos",
        F.when(F.col("pos") + SHORT_K <= F.col("n_words"), F.xxhash64(*gram(SHORT_K))).alias("hash2"),
        F.when(F.col("pos") + LONG_K <= F.col("n_words"), F.xxhash64(*gram(LONG_K))).alias("hash5"),
        *[F.get("words", F.col("pos") + i).alias(f"w{i}") for i in range(LONG_K)],
    )

    def same(name: str, k: int) -> Column:
        return F.col(f"{name}_gram") == F.concat_ws(" ", *[F.col(f"w{i}") for i in range(k)])

    matched = hashed.join(F.broadcast(short), (F.col("hash2") == F.col("short_hash")) & same("short", SHORT_K), "left")
    matched = matched.join(F.broadcast(long), (F.col("hash5") == F.col("long_hash")) & same("long", LONG_K), "left")
    # The first position of a document also stands for the document itself, as template -1.
    head = F.coalesce(F.col("pos"), F.lit(0)) == 0
    votes = "array<struct<t:int,i:int,k:int>>"
    votes_of = F.concat(
        F.coalesce(F.col("short_votes"), F.array().cast(votes)),
        F.coalesce(F.col("long_votes"), F.array().cast(votes)),
        F.when(head, F.array(F.struct(F.lit(-1).alias("t"), F.lit(0).alias("i"), F.lit(1).alias("k")))).otherwise(F.array().cast(votes)),
    )
    cast = (
        matched.where(head | F.col("short_votes").isNotNull() | F.col("long_votes").isNotNull())
        .select("id", "h", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"), F.explode(votes_of).alias("v"))
        .select("id", "h", "n_words", "pos", "v.t", "v.i", "v.k", (F.col("pos") - F.col("v.i")).alias("diagonal"))
    )
    by_place = cast.groupBy("id", "h", "n_words", "t", "diagonal", "i").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    diagonals = by_place.groupBy("id", "h", "n_words", "t", "diagonal").agg(
        F.count("*").alias("votes"), F.max("n").alias("n"), F.min("i").alias("first"), F.max(F.col("i") + F.col("k")).alias("end")
    )
    # Neighbouring diagonals of a notice follow each other in the text; a gap or a jump begins a new span.
    order = Window.partitionBy("id", "h", "t").orderBy(F.col("diagonal") + F.col("first"), "diagonal")
    notice = F.col("t").isin([i for i, k in size.items() if k == LONG_K])
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > SHIFT) | (
        F.col("diagonal") + F.col("first") - F.lag(F.col("diagonal") + F.col("end")).over(order) > GAP
    )
    spans = (
        diagonals.withColumn("new", F.when(~notice | F.coalesce(apart, F.lit(True)), 1).otherwise(0))
        .withColumn("span", F.sum("new").over(order))
        .groupBy("id", "h", "n_words", "t", "span")
        .agg(F.sum("votes").alias("votes"), F.max("n").alias("n"), F.min(F.col("diagonal") + F.col("first")).alias("start"), F.max(F.col("diagonal") + F.col("end")).alias("end"))
    )
    facts = F.create_map(
        *[x for i, t, w in known for x in (F.lit(i), F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(len(w) - size[i] + 1).alias("grams"), F.lit(size[i] == LONG_K).alias("notice")))]
    )
    told = spans.withColumn("f", facts[F.col("t")])
    share = F.least(F.lit(1.0), F.col("votes") / F.col("f.grams"))
    # A notice is verified by how much of it voted, and of the span by how many of its words are the notice's.
    dense = F.col("votes") >= LEAST_SHARE * (F.col("end") - F.col("start") - LONG_K + 1)
    told = told.withColumn("share", share).withColumn(
        "ok", F.when(F.col("t") < 0, False).when(F.col("f.notice"), (share >= LEAST_SHARE) & dense).otherwise(F.col("votes") >= F.col("f.grams"))
    )
    found, is_base = F.col("ok"), F.col("ok") & F.col("f.base")
    label = F.col("f.label")
    result = told.groupBy("id", "h", "n_words").agg(
        F.max(F.when(F.col("t") < 0, F.col("n"))).alias("copies"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(is_base, label)).alias("base_set"),
        F.collect_set(F.when(found, label)).alias("label_set"),
        F.max(F.when(found, F.col("share"))).alias("score"),
        F.collect_list(
            F.when(found, F.struct(F.col("start").cast("long").alias("first"), (F.col("end") - 1).cast("long").alias("last"), label.alias("label"), F.col("share")))
        ).alias("spans"),
    )
    return result.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        "n_base",
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_set"), ",").alias("base_labels"),
        F.array_join(F.array_sort("label_set"), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.array_sort("spans").alias("spans"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
