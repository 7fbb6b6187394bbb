"""A landed file may be a folder of parts, so that no task has to write or read a whole file."""

import glob

from nichelens.plans import import_queries as iq
from nichelens.sources import exports

SF = "/root/testdata/sf0.001"


def test_parts_are_read_as_one_file(spark, monkeypatch):
    def rows(path, in_parts):
        found = exports.read_export_csv(spark, path, block_lines=64, cell_chars=1 << 24, in_parts=in_parts)[1]
        return sorted(map(tuple, found.select(iq._file_number("file"), "line_no", "cells").collect()))

    whole = rows(iq.land_exports(spark, SF, files=3, cyrillic=True), False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        path = iq.land_exports(spark, SF, files=3, cyrillic=True, in_parts=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(glob.glob(f"{path}/*/part*")) > 6
    assert rows(path, True) == whole and len(whole) > 100
