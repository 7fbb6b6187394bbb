"""A row's raw cells: names are made once a row, however many cells look at them."""

from pyspark.sql import functions as F

from nichelens.operators import importing as imp


def test_names_are_made_once(spark):
    rows = spark.createDataFrame(
        [(["a", "b", "a"], ["1", "2", "3"]), (["", None, "x"], ["1", None, "3", "4"]), (["a"], []), (None, ["1"]), (["a"], None), (["column_2", ""], ["1", "2"])],
        "h array<string>, c array<string>",
    )
    found = rows.select(imp.raw_map(F.col("h"), F.col("c")).alias("raw"))
    assert [r["raw"] for r in found.collect()] == [
        {"b": "2", "a": "3"}, {"column_1": "1", "column_2": None, "x": "3", "column_4": "4"}, {}, {"column_1": "1"}, None, {"column_2": "2"},
    ]
    assert found._jdf.queryExecution().analyzed().toString().count("element_at(") <= 2
