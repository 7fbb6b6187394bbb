"""Column expressions that turn dirty export cells into typed values.

Nothing raises: a parser returns a struct whose ``error`` (and, where the rule
has one, ``warning``) says why ``value`` is NULL, and the caller decides what
that costs the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spaces, apostrophes, suffixes, currencies, hosts, labels.
EXOTIC_SPACES = "\u00a0\u202f\u2009\u2007\u2060\u200b"
APOSTROPHES = "'\u2019\u02bc"
MAGNITUDES = {
    "МЛН": 1_000_000,
    "ТЫС": 1_000,
    "К": 1_000,
    "K": 1_000,
    "М": 1_000_000,
    "M": 1_000_000,
}
CURRENCY_TOKENS = {
    "₽": "RUB",
    "руб.": "RUB",
    "rub": "RUB",
    "руб": "RUB",
    "$": "USD",
    "usd": "USD",
    "€": "EUR",
    "eur": "EUR",
}
TELEGRAM_HOSTS = ("t.me", "telegram.me", "telegram.dog")
MAX_HOSTS = ("max.ru",)
TELEGRAM_LABELS = ("telegram", "телеграм", "телеграмм", "tg", "тг")
MAX_LABELS = ("max", "макс", "мах")
HEADER_PUNCTUATION = r"[.,;:()\[\]{}\"'`«»№/\\|+*]"
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh",
    "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y",
    "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
DATE_PATTERNS = {
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
}

# Every Unicode space by code point: Java's \s knows ASCII only, and its Unicode
# mode is several times slower than an explicit class.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NUMBER_TYPE = "decimal(27,9)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Inlining a parsed cell into every place that reads it multiplies the
    expression tree until generated code no longer compiles; binding it keeps
    each parser small and evaluates the regular expressions once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ws(c: Column) -> Column:
    """Trim any Unicode whitespace."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip_ws(c) == "")


def clean_text(c: Column) -> Column:
    """Collapse all kinds of spaces; blank becomes NULL."""
    spaced = F.translate(c, EXOTIC_SPACES, " " * len(EXOTIC_SPACES))
    return let(F.trim(F.regexp_replace(spaced, f"{WS}+", " ")), blank_to_null)


def normalize_header(c: Column) -> Column:
    """What two headers share when they name one column: case, ``ё``, punctuation, dashes and spacing are
    evened out. A percent sign is left, as it tells in which unit the column is written."""
    text = F.translate(F.lower(F.coalesce(clean_text(c), F.lit(""))), "ё", "е")
    text = F.regexp_replace(text, HEADER_PUNCTUATION, " ")
    text = F.regexp_replace(text, "[–—−]", "-")
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def _quoted(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.lit("'"), c, F.lit("'"))


def to_decimal(c: Column, prefer_thousands_group: bool) -> Column:
    """A cell read as a number: ``struct(value decimal(35,9), error string)``, one of them NULL.

    Decimal commas and points, grouped digits and words for thousands and
    millions are understood. One separator before three digits can mean either;
    with ``prefer_thousands_group`` it groups (1,240 subscribers), else it is
    the decimal sign (1,240 per view).
    """
    noise = EXOTIC_SPACES + APOSTROPHES + " "
    suffixes = "|".join(sorted(MAGNITUDES, key=len, reverse=True))
    split = rf"(?iu)^(.+)({suffixes})$"
    thousand = [key for key, factor in MAGNITUDES.items() if factor == 1_000]

    def pieces(text: Column) -> Column:
        suffix = F.upper(F.regexp_extract(text, split, 2))
        factor = (
            F.when(suffix == "", F.lit(1))
            .when(suffix.isin(thousand), F.lit(1_000))
            .otherwise(F.lit(1_000_000))
        )
        digits = F.coalesce(blank_to_null(F.regexp_extract(text, split, 1)), text)
        return F.struct(
            text.alias("text"),
            factor.cast("decimal(7,0)").alias("factor"),
            F.when(digits.rlike(r"^[+-]?[0-9.,]+$"), digits).alias("digits"),
        )

    def number(part: Column) -> Column:
        digits = part["digits"]
        commas = F.length(F.translate(digits, "+-0123456789.", ""))
        dots = F.length(F.translate(digits, "+-0123456789,", ""))
        grouped = (commas + dots) > 1
        if prefer_thousands_group:
            grouped = grouped | digits.rlike(r"[.,][^.,]{3}$")
        plain = (
            F.when((commas > 0) & (dots > 0) & digits.rlike(r",[^.,]*$"), F.translate(digits, ",.", "."))
            .when((commas > 0) & (dots > 0), F.translate(digits, ",", ""))
            .when(grouped, F.translate(digits, ",.", ""))
            .otherwise(F.translate(digits, ",", "."))
        )
        return F.struct(
            (plain.try_cast(NUMBER_TYPE) * part["factor"]).alias("value"),
            part["text"].alias("text"),
        )

    def checked(result: Column) -> Column:
        error = (
            F.when(c.isNull(), F.lit(None).cast("string"))
            .when(result["text"] == "", F.lit("empty numeric value"))
            .when(result["value"].isNull(), _quoted("not a number: ", c))
        )
        return F.struct(result["value"].alias("value"), error.alias("error"))

    cleaned = F.translate(strip_ws(c), noise, "")
    return let(let(let(cleaned, pieces), number), checked)


def parse_int(c: Column, scale: Column | int = 1) -> Column:
    """``struct(value bigint, error)``; the unit scale applies before the whole-number check."""
    factor = (scale if isinstance(scale, Column) else F.lit(scale)).cast("decimal(10,0)")

    def scaled(parsed: Column) -> Column:
        number = (parsed["value"].try_cast("decimal(28,9)") * factor).try_cast("decimal(38,9)")
        return F.struct(number.alias("number"), parsed["error"].alias("error"))

    def checked(result: Column) -> Column:
        whole = result["number"] == F.floor(result["number"])
        error = F.when(result["error"].isNotNull(), result["error"]).when(
            ~whole, _quoted("expected a whole number, got ", c)
        )
        return F.struct(
            F.when(whole, result["number"].try_cast("bigint")).alias("value"),
            error.alias("error"),
        )

    return F.when(~is_blank(c), let(let(to_decimal(c, True), scaled), checked))


def parse_decimal(c: Column, prefer_thousands_group: bool = False) -> Column:
    """``struct(value decimal(35,9), error)``; NULL for a blank cell."""
    return F.when(~is_blank(c), to_decimal(c, prefer_thousands_group))


def parse_percent(c: Column, declared_percent_points: Column | bool = False) -> Column:
    """``struct(value, warning, error)``: a fraction, whatever notation came in."""
    declared = (
        declared_percent_points
        if isinstance(declared_percent_points, Column)
        else F.lit(declared_percent_points)
    )
    signed = F.contains(c, F.lit("%"))

    def fraction(parsed: Column) -> Column:
        number = parsed["value"]
        shown = F.regexp_replace(number.cast("string"), r"\.?0+$", "")
        hundredth = (number / F.lit(100).cast("decimal(3,0)")).cast("decimal(38,12)")
        warning = (
            F.when(signed | number.isNull(), F.lit(None).cast("string"))
            .when(
                declared & (number != 0) & (number < 1),
                F.concat(
                    F.lit("column declares percent points but value "),
                    shown,
                    F.lit(" is below 1"),
                ),
            )
            .when(
                ~declared & (number > 1),
                F.concat(
                    F.lit("value "),
                    shown,
                    F.lit(" has no '%' sign; interpreted as percent points"),
                ),
            )
        )
        return F.struct(
            F.when(signed | declared | (number > 1), hundredth)
            .otherwise(number.cast("decimal(38,12)"))
            .alias("value"),
            warning.alias("warning"),
            parsed["error"].alias("error"),
        )

    return F.when(~is_blank(c), let(to_decimal(F.replace(c, F.lit("%")), False), fraction))


def parse_money(c: Column) -> Column:
    """``struct(value, currency, error)``; the last token found names the currency."""
    tokens = list(CURRENCY_TOKENS.items())

    def amount(text: Column) -> Column:
        # Tokens come off one by one, so "rub" inside "руб." cannot count twice.
        currency, rest = F.lit(None).cast("string"), text
        for token, code in tokens:
            currency = F.when(F.contains(rest, F.lit(token)), F.lit(code)).otherwise(currency)
            rest = F.replace(rest, F.lit(token))
        return F.struct(rest.alias("rest"), currency.alias("currency"))

    def priced(split: Column) -> Column:
        return let(
            to_decimal(split["rest"], True),
            lambda parsed: F.struct(
                parsed["value"].alias("value"),
                F.when(parsed["value"].isNotNull(), split["currency"]).alias("currency"),
                parsed["error"].alias("error"),
            ),
        )

    return F.when(~is_blank(c), let(let(F.lower(strip_ws(c)), amount), priced))


def parse_date(c: Column) -> Column:
    """``struct(value date, error)``: ISO first, then the day-first formats, never M/D/Y."""
    clock = r"\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?"

    def attempt(text: Column) -> Column:
        iso = F.when(
            text.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}([T ]{clock})?$"),
            F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"),
        ).when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
        loose = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))
        # A failed parse costs an exception, so only the fitting pattern is tried.
        full = [
            F.when(text.rlike(shape), F.try_to_date(text, pattern))
            for pattern, shape in DATE_PATTERNS.items()
        ]
        short = F.when(
            text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{2}$"), F.try_to_date(text, "d.M.yy")
        )
        # Two-digit years from 69 on belong to the last century.
        short = let(short, lambda d: F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d))
        return F.coalesce(iso, loose, *full, short)

    def checked(value: Column) -> Column:
        error = F.when(value.isNull(), _quoted("unrecognized date format: ", c))
        return F.struct(value.alias("value"), error.alias("error"))

    return F.when(~is_blank(c), let(let(strip_ws(c), attempt), checked))


def looks_like_handle(c: Column) -> Column:
    text = clean_text(c)
    return F.coalesce(text.startswith("@") & (F.length(text) > 1), F.lit(False))


def normalize_handle(c: Column) -> Column:
    return blank_to_null(F.lower(F.ltrim(clean_text(c), F.lit("@"))))


def url_host(url: Column) -> Column:
    """Lower-cased authority of an absolute URL."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), r"/+$", "")


def normalize_url(c: Column) -> Column:
    """``struct(value, error)``: scheme://host/path, or why not."""

    def absolute(text: Column) -> Column:
        url = F.when(text.rlike(r"(?i)^https?://"), text).when(
            text.rlike(r"(?iU)^[\w.-]+\.[a-z]{2,}(/|$)"), F.concat(F.lit("https://"), text)
        )
        return F.struct(text.alias("text"), url.alias("url"))

    def rebuilt(part: Column) -> Column:
        url = part["url"]
        scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
        host = url_host(url)
        return F.struct(
            part["text"].alias("text"),
            F.when(host != "", F.concat(scheme, F.lit("://"), host, _url_path(url))).alias("value"),
        )

    def checked(result: Column) -> Column:
        handle = result["text"].startswith("@")
        error = F.when(handle, _quoted("value looks like a handle, not a URL: ", c)).when(
            result["text"].isNotNull() & result["value"].isNull(), _quoted("malformed URL: ", c)
        )
        return F.struct(
            F.when(~handle, result["value"]).alias("value"), error.alias("error")
        )

    return let(let(let(clean_text(c), absolute), rebuilt), checked)


def _on_hosts(host: Column, hosts: tuple[str, ...]) -> Column:
    escaped = "|".join(name.replace(".", r"\.") for name in hosts)
    return host.rlike(rf"^(.*\.)?({escaped})$")


def detect_platform(label: Column, url: Column) -> Column:
    """Explicit label first, then the host of the URL."""


    def named(name: Column) -> Column:
        return F.when(name.isin(*TELEGRAM_LABELS), F.lit("TELEGRAM")).when(
            name.isin(*MAX_LABELS), F.lit("MAX")
        )

    def hosted(host: Column) -> Column:
        return F.when(_on_hosts(host, TELEGRAM_HOSTS), F.lit("TELEGRAM")).when(
            _on_hosts(host, MAX_HOSTS), F.lit("MAX")
        )

    return F.coalesce(
        let(normalize_header(label), named), let(url_host(url), hosted), F.lit("UNKNOWN")
    )


def slugify(c: Column, max_length: int | None = None) -> Column:
    """Transliterated label usable as a key; whole unless ``max_length`` is given."""
    text = F.translate(F.lower(F.coalesce(clean_text(c), F.lit(""))), "ё", "е")
    for letter, latin in TRANSLITERATION.items():
        if len(latin) > 1:
            text = F.replace(text, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in TRANSLITERATION.items() if len(v) == 1}
    silent = "".join(k for k, v in TRANSLITERATION.items() if not v)
    text = F.translate(text, "".join(single) + silent, "".join(single.values()))
    text = F.trim(F.regexp_replace(text, r"[^a-z0-9]+", "-"), F.lit("-"))
    if max_length is not None:
        text = F.substring(text, 1, max_length)
    return F.coalesce(let(text, blank_to_null), F.lit("unknown"))


def build_dedupe_key(
    external_id: Column, handle: Column, url: Column, name: Column
) -> Column:
    """Most stable identifier first; NULL when there is none."""
    external = blank_to_null(F.lower(strip_ws(external_id)))
    named = F.when(~is_blank(name), slugify(name))
    return F.coalesce(
        F.concat(F.lit("ext:"), external),
        F.concat(F.lit("handle:"), blank_to_null(F.lower(handle))),
        F.when(url != "", F.concat(F.lit("url:"), url_host(url), F.lower(_url_path(url)))),
        F.concat(F.lit("name:"), named),
    )
