from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from nichelens.functions import normalize as n


def check(values, pairs, expression):
    got = values([p[0] for p in pairs], expression)
    assert got == [p[1] for p in pairs]


def test_parse_int(values):
    pairs = [
        ("1.240", 1240), ("1240.0", 1240), ("1 234 567", 1234567), ("2К", 2000), ("1.5К", 1500),
        ("3 тыс", 3000), ("1,2 млн", 1200000), ("2K", 2000), ("1.5m", 1500000), ("1 240", 1240),
        ("1'240", 1240), ("1,240", 1240), ("12,5", None), ("1 200 шт", None), ("", None), (None, None),
        ("К", None), ("-5", -5), ("+7", 7), ("1.2.3", 123), ("1e5", None),
    ]
    check(values, pairs, lambda c: n.parse_int(c)["value"])


def test_parse_int_says_why(values):
    got = values(["12,5", "шт", " ", "7"], lambda c: n.parse_int(c)["error"])
    assert got[0] == "expected a whole number, got '12,5'"
    assert got[1] == "not a number: 'шт'"
    assert got[2] is None and got[3] is None


def test_scale_applies_before_the_whole_number_check(values):
    check(values, [("0.1", 100), ("0,25", 250), ("0.0001", None)], lambda c: n.parse_int(c, 1000)["value"])


def test_parse_decimal(values):
    pairs = [
        ("1,25", Decimal("1.25")), ("1.234,56", Decimal("1234.56")), ("1,234.56", Decimal("1234.56")),
        ("1,240", Decimal("1.240")), (".5", Decimal("0.5")), ("5.", Decimal("5")), (",", None), ("x", None),
    ]
    check(values, pairs, lambda c: n.parse_decimal(c)["value"])


@pytest.mark.parametrize(
    ("text", "declared", "value", "warned"),
    [
        ("24,7%", False, "0.247", False),
        ("24.7", False, "0.247", True),
        ("0.247", False, "0.247", False),
        ("1", False, "1", False),
        ("1", True, "0.01", False),
        ("0", True, "0", False),
        ("0.5", True, "0.005", True),
        ("7", True, "0.07", False),
    ],
)
def test_parse_percent(values, text, declared, value, warned):
    got = values([text], lambda c: n.parse_percent(c, declared))[0]
    assert got["value"] == Decimal(value)
    assert (got["warning"] is not None) == warned


def test_parse_money(values):
    pairs = [
        ("15 000 ₽", (Decimal(15000), "RUB")), ("$1,240", (Decimal(1240), "USD")),
        ("1 500 руб.", (Decimal(1500), "RUB")), ("99 EUR", (Decimal(99), "EUR")),
        ("100", (Decimal(100), None)), ("5 rub $", (Decimal(5), "USD")),
    ]
    got = values([p[0] for p in pairs], n.parse_money)
    assert [(g["value"], g["currency"]) for g in got] == [p[1] for p in pairs]


def test_parse_date(values):
    pairs = [
        ("2026-09-01", date(2026, 9, 1)), ("01.09.2026", date(2026, 9, 1)), ("1/9/2026", date(2026, 9, 1)),
        ("2026/9/1", date(2026, 9, 1)), ("01-09-2026", date(2026, 9, 1)), ("01.09.26", date(2026, 9, 1)),
        ("01.09.70", date(1970, 9, 1)), ("2026-09-01T10:00:00Z", date(2026, 9, 1)),
        ("20260901", date(2026, 9, 1)), ("2026-02-30", None), ("13/25/2026", None), ("soon", None),
    ]
    check(values, pairs, lambda c: n.parse_date(c)["value"])


def test_urls_handles_platforms(values):
    pairs = [
        ("https://T.me/AiTools/", "https://t.me/AiTools"), ("t.me/x?y=1", "https://t.me/x"),
        ("HTTP://Max.ru/a#b", "http://max.ru/a"), ("@name", None), ("no link", None), ("https://", None),
        ("https://a.b/c;d=1", "https://a.b/c"),
    ]
    check(values, pairs, lambda c: n.normalize_url(c)["value"])
    check(values, [("@Name", "name"), (" @@X ", "x"), ("@", None), (None, None)], n.normalize_handle)
    platform = lambda c: n.detect_platform(F.lit(None).cast("string"), c)
    hosts = [
        ("https://t.me/x", "TELEGRAM"), ("https://sub.telegram.me/x", "TELEGRAM"),
        ("https://max.ru/x", "MAX"), ("https://notmax.ru/x", "UNKNOWN"), (None, "UNKNOWN"),
    ]
    check(values, hosts, platform)
    labels = [("МАКС", "MAX"), ("Tg", "TELEGRAM"), ("x", "UNKNOWN")]
    check(values, labels, lambda c: n.detect_platform(c, F.lit(None).cast("string")))


def test_labels(values):
    check(
        values,
        [("Подписчики, чел.", "подписчики чел"), ("ERR, %", "err %"), ("Вовлечённость", "вовлеченность"), (None, "")],
        n.normalize_header,
    )
    check(
        values,
        [("AI и технологии", "ai-i-tehnologii"), ("Щука ёж", "schuka-ezh"), ("!!!", "unknown"), (None, "unknown")],
        n.slugify,
    )
    check(values, [(" a  b\t", "a b"), ("​", None), ("", None)], n.clean_text)


def test_dedupe_key_prefers_stable_identifiers(spark):
    rows = [
        (" X1 ", "h", "https://t.me/a", "Name", "ext:x1"),
        (None, "H", "https://t.me/a", "Name", "handle:h"),
        ("", None, "https://T.me/Aa/", "Name", "url:t.me/aa"),
        (None, None, None, "Имя", "name:imya"),
        (None, None, None, " ", None),
    ]
    df = spark.createDataFrame(rows, "e string, h string, u string, n string, want string")
    key = n.build_dedupe_key(*[F.col(c) for c in "ehun"])
    assert all(r["k"] == r["want"] for r in df.select(key.alias("k"), "want").collect())
