"""Reading export files: quoted cells over lines, delimiters, checksums; bucketed tables."""

import csv
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from nichelens.sources import exports, sinks


def name(row):
    return os.path.basename(row["file"] if "file" in row else row["path"])


def land(path, texts, encoding="utf-8"):
    path.mkdir()
    for file, text in texts.items():
        (path / file).write_bytes(text.encode(encoding))
    return str(path)


@pytest.fixture
def splits(spark):
    """Very small file splits, so that records run over several."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def noisy_files(seed):
    r = random.Random(seed)
    texts = {}
    for k in range(12):
        mark = ";,\t"[k % 3]
        signs = ['"', '"', "a", mark, "\n", "\n", '""', f'"{mark}', f'{mark}"', "\r\n", "\r", "\x0b", "é", " ", " "]
        head = mark.join("ABCDEFGH") + "\n"
        texts[f"f{k}.csv"] = head + "".join(r.choice(signs) for _ in range(r.randint(0, 300))) + "\n"
    return texts


@pytest.mark.parametrize("block_lines", [1, 7, 65_536])
def test_quoted_records_equal_the_standard_reader(spark, tmp_path, splits, block_lines):
    texts = noisy_files(block_lines)
    path = land(tmp_path / "x", texts)
    lines = exports.read_lines(spark, path)
    decoded = exports.decode_lines(lines, exports.detect_encoding(lines))
    marks = F.element_at(F.array(*[F.lit(d) for d in ";,\t"]), F.regexp_extract("file", r"f(\d+)\.csv", 1).cast("int") % 3 + 1)
    physical = exports.physical_lines(decoded).withColumn("delimiter", marks)
    records, broken = exports.quoted_records(physical, block_lines)
    cells = exports.record_cells(F.col("value"), F.col("delimiter"), F.col("open")).alias("cells")
    got = {}
    for row in records.select("file", "line_no", cells).collect():
        got.setdefault(name(row), {})[row["line_no"]] = row["cells"]
    for k, (file, text) in enumerate(texts.items()):
        want = list(csv.reader(text.splitlines(), delimiter=";,\t"[k % 3]))
        assert [got[file][i + 1] for i in range(len(got[file]))] == want, file
    assert broken.count() == 0


def test_line_breaks_in_cells(spark, tmp_path, splits):
    filler = "".join(f"{i};x\n" for i in range(300))
    text = 'Канал;n\n"a\nb";1\n"c\r\nd";2\n"e\rf";3\r"g ""h"" ;\n\n";4\n' + filler + '"open;\nend'
    header, rows = exports.read_export_csv(spark, land(tmp_path / "x", {"e.csv": text}), block_lines=50)
    got = {r["line_no"]: r["cells"] for r in rows.collect()}
    assert header.first()["headers"] == ["Канал", "n"]
    assert [got[i] for i in (2, 3, 4, 5)] == [["ab", "1"], ["cd", "2"], ["ef", "3"], ['g "h" ;', "4"]]
    assert got[6] == ["0", "x"] and got[306] == ["open;end"] and len(got) == 305


def test_too_long_a_cell_makes_a_file_unusable(spark, tmp_path):
    texts = {"a.csv": "x;y\n" + "a" * 101 + ";1\n", "b.csv": "x;y\n" + "a" * 100 + ";1\n", "c.csv": 'x;y\n"' + "abc\n" * 999, "d.csv": ""}
    header, rows = exports.read_export_csv(spark, land(tmp_path / "x", texts), cell_chars=100)
    assert {name(r) for r in rows.collect()} == {"b.csv"}
    assert {name(r): r["headers"] for r in header.collect()} == {"a.csv": None, "b.csv": ["x", "y"], "c.csv": None}


def dialects(spark, files):
    rows = [(f, i, v) for f, lines in files.items() for i, v in enumerate(lines, 1)]
    return {r["file"]: r["delimiter"] for r in exports.dialect(spark.createDataFrame(rows, "file string, line_no long, value string")).collect()}


def test_dialect(spark):
    got = dialects(
        spark,
        {
            "commas in quotes": ["Имя;n"] + ['"a, b, c, d";1', '"e, f, g, h, i";2'] * 9,
            "commas in cells": ["a;b;c"] + ["1,5;2,5;x", "1;2,5;y,z,"] * 9,
            "title": ["Отчёт, за год"] + ["a\tb\tc"] * 30,
            "decimals": ["n,5"] * 20 + ["n,5;6"],
            "quoted tie": ['"a";"b"', '"c","d"'],
            "one cell": ["just a title"],
            "first line": ["a;b;c", "d,e", "", "f,g,h,i", "x"],
            "late": ["a;b"] * 3000 + ["a,b,c,d"] * 9000,
            "empty": [""],
        },
    )
    assert got == {
        "commas in quotes": ";", "commas in cells": ";", "title": "\t", "decimals": ",", "quoted tie": ",",
        "one cell": ";", "first line": ";", "late": ";", "empty": ";",
    }


def test_commas_in_quoted_cells_are_read(spark, tmp_path):
    lines = ["Канал;Подписчики"] + [f'"Новости, {i}, и, прочее";{i}' for i in range(30)]
    _, rows = exports.read_export_csv(spark, land(tmp_path / "x", {"e.csv": "\n".join(lines)}, "cp1251"))
    assert sorted(r["cells"][1] for r in rows.collect()) == sorted(str(i) for i in range(30))


@pytest.mark.parametrize("chunk", [1, 1000, 1 << 20])
def test_checksums_are_streamed(spark, tmp_path, chunk):
    r = random.Random(3)
    bodies = {"empty": b"", "zeros": bytes(5000), "a b%20é": r.randbytes(3001)}
    for file, body in bodies.items():
        (tmp_path / file).write_bytes(body)
    got = {row["path"].split("/")[-1]: (row["checksum"], row["file_size"]) for row in exports.sha256_files(spark, str(tmp_path), chunk).collect()}
    assert sorted(got.values()) == sorted((hashlib.sha256(b).hexdigest(), len(b)) for b in bodies.values() if b)


def files_by_bucket(path):
    return {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in path.rglob("*.parquet")}


def test_one_changed_key_rewrites_one_bucket(spark, tmp_path):
    path = tmp_path / "t"
    schema = "k long, label string, n int"
    stored = [(i, f"s{i}", None if i % 2 else i) for i in range(500)] + [(None, "none", 1)]
    sinks.write_buckets(spark.createDataFrame(stored, schema), str(path), ["k"], 16)
    before = files_by_bucket(path)
    assert len(before) == 16
    touched = sinks.upsert_buckets(spark, str(path), spark.createDataFrame([(7, "new", 70)], schema), ["k"], 16, fill_only=["n"])
    after = files_by_bucket(path)
    assert len(touched) == 1 and {b for b in before if before[b] != after[b]} == {f"bucket={touched[0]}"}
    want = {(i, label, n) for i, label, n in stored if i != 7} | {(7, "new", 70)}
    assert {tuple(r) for r in sinks.read_buckets(spark, str(path)).select("k", "label", "n").collect()} == want
    # New keys, and the same rows again.
    more = spark.createDataFrame([(8, "again", 80), (900, "fresh", None)], schema)
    for _ in range(2):
        sinks.upsert_buckets(spark, str(path), more, ["k"], 16, fill_only=["n"])
    want = {r for r in want if r[0] != 8} | {(8, "again", 8), (900, "fresh", None)}
    rows = [tuple(r) for r in sinks.read_buckets(spark, str(path)).select("k", "label", "n").collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert sinks.upsert_buckets(spark, str(path), more.limit(0), ["k"], 16) == []
