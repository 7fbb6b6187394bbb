from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from nichelens.operators import importing as imp
from nichelens.sources import exports, sinks

HEADER = "Канал;Ссылка;Категория;Подписчики;ERR;Прогноз просмотров;CPV;Стоимость размещения;Дата"
ROWS = [
    "AI Tools;https://t.me/aitools;AI и технологии;12 500;24,7%;3 200;1,25;15 000 ₽;2026-09-01",
    "Neuro News;https://t.me/neuronews;AI и технологии;8 000;18,2%;1 900;0,95;9 500 ₽;2026-09-01",
    "Career IT;https://max.ru/careerit;Карьера;5 000;12,0%;900;1,10;6 000 ₽;2026-09-01",
]


def load(spark, path):
    header, rows = exports.read_export_csv(spark, str(path))
    headers = header.select(F.col("file").alias("import_id"), "headers")
    cells = rows.select(F.col("file").alias("import_id"), F.col("line_no").alias("row_number"), "cells")
    return headers, cells


def normalized(spark, path):
    headers, cells = load(spark, path)
    mapping = imp.map_columns(headers, imp.alias_table(spark))
    profile = imp.import_profile(headers, mapping)
    return imp.normalize_rows(cells, profile, "2026-01-01")


def write(path, lines, encoding="utf-8", end="\n"):
    path.mkdir(parents=True, exist_ok=True)
    (path / "export.csv").write_bytes((end.join(lines) + end).encode(encoding))
    return path


def test_export_to_typed_rows(spark, tmp_path):
    for name, encoding, end in (("u", "utf-8", "\n"), ("b", "utf-8-sig", "\r\n")):
        path = write(tmp_path / name, ["Отчёт", "", HEADER, *ROWS, ""], encoding, end)
        rows = {r["channel_name"]: r for r in normalized(spark, path).collect()}
        ai = rows["AI Tools"]
        assert ai["row_number"] == 4 and ai["subscribers"] == 12500 and ai["err"] == Decimal("0.247")
        assert ai["predicted_views"] == 3200 and ai["cpv"] == Decimal("1.25")
        assert ai["campaign_price"] == 15000 and ai["currency"] == "RUB"
        assert ai["snapshot_date"] == date(2026, 9, 1) and ai["dedupe_key"] == "url:t.me/aitools"
        assert rows["Career IT"]["platform"] == "MAX" and ai["errors"] == [] and ai["warnings"] == []


def test_cyrillic_code_page(spark, tmp_path):
    lines = [HEADER, *[r.replace("₽", "руб.") for r in ROWS]]
    path = write(tmp_path / "c", lines, "cp1251")
    rows = normalized(spark, path).collect()
    assert {r["category"] for r in rows} == {"AI и технологии", "Карьера"}
    assert {r["currency"] for r in rows} == {"RUB"}


def test_many_splits_keep_line_numbers(spark, tmp_path):
    path = write(tmp_path / "s", [f"line {i};x" for i in range(1, 5001)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = exports.read_lines(spark, str(path))
        got = lines.select("line_no", F.col("bytes").cast("string").alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 5000 and all(r["t"] == f"line {r['line_no']};x" for r in got)


def test_header_is_the_widest_row_and_bad_files_are_fatal(spark, tmp_path):
    path = write(tmp_path / "h", ["Всего;100", "Канал;Подписчики;Прочее", "A;1;x", ";;", "B;2;y"])
    headers, cells = load(spark, path)
    assert headers.first()["headers"] == ["Канал", "Подписчики", "Прочее"]
    assert [r["row_number"] for r in cells.orderBy("row_number").collect()] == [3, 5]
    for number, lines in enumerate((["just a title"], ["Имя;Подписчики", "A;1"], [HEADER])):
        names, rows = load(spark, write(tmp_path / f"f{number}", lines))
        mapping = imp.map_columns(names.filter("headers IS NOT NULL"), imp.alias_table(spark))
        missing = imp.missing_required(names.filter("headers IS NOT NULL"), mapping)
        reason = imp.fatal_files(names, missing, rows).first()["reason"]
        assert reason.split(":")[0] == (
            "no header row found",
            "required columns not found",
            "file contains a header but no data rows",
        )[number]


def rows_frame(spark, rows):
    schema = (
        "row_number int, channel_name string, platform string, dedupe_key string, channel_url string, "
        "external_id string, category string, snapshot_date string, ok boolean"
    )
    return spark.createDataFrame(rows, schema).selectExpr(
        "'i1' AS import_id", "* EXCEPT (snapshot_date, ok)", "cast(snapshot_date AS date) AS snapshot_date",
        "IF(ok, array(), array('bad')) AS errors", "cast(array() AS array<string>) AS warnings",
    )


def test_identity_fills_but_never_renames(spark):
    rows = rows_frame(
        spark,
        [
            (1, "New name", "MAX", "k", None, None, None, "2026-09-05", True),
            (2, "Later", "MAX", "k", "https://max.ru/k", "X", "Ниша", "2026-09-01", True),
            (3, "Bad", "MAX", "other", None, None, None, "2026-09-01", False),
            (4, "Repeat", "MAX", "k", "https://max.ru/z", None, None, "2026-09-01", True),
        ],
    )
    existing = spark.createDataFrame(
        [("MAX", "k", "Stored", None, None, None, date(2026, 9, 3), date(2026, 9, 3))],
        "platform string, dedupe_key string, channel_name string, channel_url string, external_id string, "
        "niche_slug string, first_seen_date date, last_seen_date date",
    )
    (row,) = imp.resolve_channels(rows, existing).collect()
    assert (row["channel_name"], row["channel_url"], row["external_id"], row["niche_slug"]) == (
        "Stored", "https://max.ru/k", "X", "nisha",
    )
    assert (row["first_seen_date"], row["last_seen_date"]) == (date(2026, 9, 1), date(2026, 9, 5))
    marked = {r["row_number"]: r for r in imp.mark_snapshots(rows).collect()}
    assert [marked[i]["is_snapshot"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert marked[4]["warnings"] == [imp.DUPLICATE_WARNING]
    outcome = imp.import_outcome(imp.mark_snapshots(rows), existing).first()
    assert (outcome["status"], outcome["snapshots_created"], outcome["duplicates_in_file"]) == ("PARTIAL", 2, 1)
    assert outcome["channels_created"] == 0


def test_labels_with_one_slug_meet(spark):
    rows = rows_frame(
        spark,
        [
            (1, "a", "MAX", "a", None, None, "ИИ", "2026-09-01", True),
            (2, "b", "MAX", "b", None, None, "ии!", "2026-09-01", True),
            (3, "c", "MAX", "c", None, None, "Карьера", "2026-09-01", True),
        ],
    )
    existing = spark.createDataFrame([("n1", "karera", "Work")], "niche_id string, slug string, name string")
    got = {r["slug"]: r["name"] for r in imp.resolve_niches(rows, existing).collect()}
    assert got == {"karera": "Work", "ii": "ИИ"}


def test_only_completed_imports_block_a_file(spark):
    files = spark.createDataFrame([("a", "c1"), ("b", "c2")], "path string, checksum string")
    past = spark.createDataFrame([("c1", "FAILED"), ("c2", "PARTIAL")], "checksum string, status string")
    assert [r["path"] for r in imp.new_files(files, past).collect()] == ["a"]
    assert imp.new_files(files, past, force=True).count() == 2


def test_checksums_and_sinks(spark, tmp_path):
    path = write(tmp_path / "x", ["a;b"])
    row = exports.sha256_files(spark, str(path)).first()
    assert row["file_size"] == 4 and len(row["checksum"]) == 64
    current = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, label string, n int")
    incoming = spark.createDataFrame([(1, "A", 7), (2, "B", 9), (3, "C", 1)], "k int, label string, n int")
    got = {r["k"]: (r["label"], r["n"]) for r in sinks.upsert(current, incoming, ["k"], fill_only=["n"]).collect()}
    assert got == {1: ("A", 7), 2: ("B", 5), 3: ("C", 1)}
    sinks.append(current, str(tmp_path / "t"), ["k"])
    sinks.append(incoming, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    sinks.write_ranking_csv(current, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    assert text == "k,label,n\n1,a,\n2,b,5\n"


def test_failed_file_writes_nothing(spark):
    headers = spark.createDataFrame(
        [("good", ["Канал", "Подписчики"]), ("bad", ["Подписчики"]), ("none", None), ("blank", ["Канал", "Подписчики"])],
        "import_id string, headers array<string>",
    )
    rows = spark.createDataFrame(
        [("good", 2, ["A", "1"]), ("bad", 2, ["5"]), ("bad", 3, ["6"])], "import_id string, row_number long, cells array<string>"
    )
    known = headers.filter("headers IS NOT NULL")
    mapping = imp.map_columns(known, imp.alias_table(spark))
    usable, failed = imp.split_files(headers, imp.missing_required(known, mapping), rows)
    assert [r["import_id"] for r in usable.collect()] == ["good"]
    reasons = {r["import_id"]: r["reason"] for r in failed.collect()}
    assert reasons == {
        "bad": "required columns not found: channel_name",
        "none": "no header row found",
        "blank": "file contains a header but no data rows",
    }
    marked = imp.mark_snapshots(imp.normalize_rows(usable, imp.import_profile(known, mapping), "2026-01-01"))
    existing = spark.createDataFrame([], "platform string, dedupe_key string")
    outcome = {r["import_id"]: r for r in imp.import_outcome(marked, existing, failed).collect()}
    assert outcome["good"]["status"] == "SUCCESS" and outcome["good"]["error_message"] is None
    assert outcome["bad"]["row_count"] == 0 and outcome["bad"]["error_message"] == reasons["bad"]
