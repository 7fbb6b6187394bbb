"""Small tables with every awkward row: nulls, blanks, ties, repeated rows, clashing columns, no rows."""

import pytest
from odd_rows import DOCUMENTS, NAMES, benchmark_rows, document_rows, page_rows
from pyspark.sql import functions as F

def write_tables(spark, folder, rows: bool):
    extra = [F.lit(None).cast("string").alias(n) for n in NAMES.split()]
    for name, data, schema in (
        ("documents", document_rows(), DOCUMENTS), ("benchmark", benchmark_rows(), "item_id string, text string"), ("pages", page_rows(), "page_id long, url string, html string"),
    ):
        df = spark.createDataFrame(data if rows else [], schema)
        if name != "documents":
            df = df.select("*", *[F.lit(1).alias("n_words"), F.lit("z").alias("id")])
        else:
            df = df.select("*", *extra)
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("odd"), True)


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty"), False)
