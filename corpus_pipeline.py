"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Each stage works on all that the one before it kept. Rows of one id are one document: when one of them
goes, all go. Documents without an id pass the stages that need one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelens.llm import bpe, decontam, langid, neardup, repeats
from nichelens.llm.common import held_out, table
from nichelens.llm.queries import PATTERN, RANKS
from nichelens.session import shared_folder, ship

#: Mean probability below which a language is not believed.
LEAST_SCORE = 0.3


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one, to be handed through an operator."""
    return F.struct(*[F.col(c) for c in docs.columns]).alias("row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: without a letter, or with no language likelier than the rest, they go."""
    net = langid.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    said = langid.predict(docs.select(whole_row(docs), "text"), net, id_col="row")
    return said.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id."""
    others = neardup.classes(docs.select("doc_id", "text")).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(others.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document holds; n_chars follows.

    A cut may fall within a character; what is left of its bytes goes too.
    """
    cut = repeats.remove(docs.select(whole_row(docs), "doc_id"), text_col="row.text", row_col="row", whole_characters=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept").cast("string"))
    changed = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    scanned = decontam.scan(docs.select(whole_row(docs), "text"), table(spark, sf_dir, "benchmark"), id_col="row")
    return scanned.where("n_hit = 0").select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded bytes of what is kept, as digests."""
    return bpe.digests(bpe.round_trip(docs, RANKS, PATTERN))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontaminated", decontaminated),
    ("byte_bpe", byte_bpe),
]

#: SQL has neither the recurrent network nor BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read back."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
