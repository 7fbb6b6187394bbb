"""Landed payloads to raw research items: release JSON, feeds, listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nichelens.functions.html import strip_html, unescape
from nichelens.functions.normalize import WS, blank_to_null, strip_ws

# Fixed value: shorter link texts are navigation.
MIN_LINK_TEXT = 12

RELEASE_SCHEMA = (
    "array<struct<id: string, html_url: string, name: string, tag_name: string, body: string, "
    "draft: boolean, prerelease: boolean, published_at: string, created_at: string, "
    "author: struct<login: string>>>"
)
RSS_ITEM_SCHEMA = (
    "struct<title: string, link: string, guid: string, description: string, pubDate: string, "
    "author: string, category: array<string>>"
)
ATOM_ENTRY_SCHEMA = (
    "struct<title: string, link: array<struct<_href: string, _rel: string>>, id: string, "
    "summary: string, content: string, published: string, updated: string, "
    "author: struct<name: string>>"
)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole small payload files as ``(file, payload)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload")
    )


def _head(c: Column, limit: int | None) -> Column:
    return c if limit is None else F.substring(c, 1, limit)


def read_releases_json(
    payloads: DataFrame,
    title_limit: int | None = None,
    summary_limit: int | None = None,
    excerpt_limit: int | None = None,
) -> DataFrame:
    """Items of ``payloads(source_key, repo, payload)``; drafts are dropped.

    Texts are kept whole unless a store with narrow columns asks for limits.
    """
    release = payloads.select(
        "source_key", "repo", F.posexplode(F.from_json("payload", RELEASE_SCHEMA)).alias("arrival", "r")
    ).filter(~F.coalesce("r.draft", F.lit(False)))
    body = strip_ws(F.coalesce("r.body", F.lit("")))
    title = F.coalesce(
        blank_to_null(F.col("r.name")), blank_to_null(F.col("r.tag_name")), F.col("repo")
    )
    page = F.concat(F.lit("https://github.com/"), F.col("repo"), F.lit("/releases"))
    published = F.coalesce(
        blank_to_null(F.col("r.published_at")), blank_to_null(F.col("r.created_at"))
    )
    return release.select(
        "source_key",
        "arrival",
        F.col("r.id").alias("external_id"),
        F.coalesce(blank_to_null(F.col("r.html_url")), page).alias("url"),
        _head(title, title_limit).alias("title"),
        blank_to_null(_head(body, summary_limit)).alias("summary"),
        blank_to_null(_head(body, excerpt_limit)).alias("content_excerpt"),
        published.try_cast("timestamp").alias("published_at"),
        F.col("r.author.login").alias("author"),
        F.col("repo").alias("publisher"),
        F.lit("en").alias("language"),
        F.create_map(
            F.lit("tag_name"),
            F.col("r.tag_name"),
            F.lit("repo"),
            F.col("repo"),
            F.lit("prerelease"),
            F.coalesce("r.prerelease", F.lit(False)).cast("string"),
        ).alias("raw_metadata"),
    )


def _feed_date(c: Column) -> Column:
    """RFC 822 or ISO date; the weekday name is dropped, it is often wrong."""
    bare = F.regexp_replace(strip_ws(c), r"^[A-Za-z]{3,9},?\s+", "")
    zoned = F.regexp_replace(F.regexp_replace(bare, r"\s(GMT|UTC|UT|Z)$", " +0000"), r"\s+", " ")
    return F.coalesce(
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")),
        F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), bare.try_cast("timestamp")),
    )


def _elements(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(
        xml, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0)
    )


def _first_element(xml: Column, tag: str) -> Column:
    inner = F.regexp_extract(xml, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    bare = F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")
    return blank_to_null(strip_ws(bare))


def read_feed_xml(
    payloads: DataFrame,
    title_limit: int | None = None,
    summary_limit: int | None = None,
    excerpt_limit: int | None = None,
    closed_references: bool = False,
) -> DataFrame:
    """Items of RSS or Atom ``payloads(source_key, payload)``.

    Entries without a link are dropped; the guid identifies an entry, the link
    is the fallback. Each entry is parsed on its own with ``from_xml``. Texts are
    kept whole unless limits are given. With ``closed_references`` a character
    reference in a title or text counts only up to its semicolon.
    """
    plain = lambda c: strip_html(c, closed_references)
    head = F.regexp_replace("payload", r"(?is)<(item|entry)[\s>].*$", "")
    split = payloads.select(
        "source_key",
        plain(_first_element(head, "title")).alias("publisher"),
        _first_element(head, "language").alias("language"),
        F.posexplode(
            F.concat(_elements(F.col("payload"), "item"), _elements(F.col("payload"), "entry"))
        ).alias("arrival", "xml"),
    )
    is_rss = F.lower(F.substring("xml", 1, 5)) == "<item"
    parsed = split.select(
        "source_key",
        "publisher",
        "language",
        "arrival",
        F.from_xml(F.when(is_rss, F.col("xml")), RSS_ITEM_SCHEMA, {"rowTag": "item"}).alias("rss"),
        F.from_xml(F.when(~is_rss, F.col("xml")), ATOM_ENTRY_SCHEMA, {"rowTag": "entry"}).alias("atom"),
    )
    alternate = F.filter("atom.link", lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(
        blank_to_null(strip_ws(F.col("rss.link"))), F.try_element_at(alternate, F.lit(1))["_href"]
    )
    text = plain(
        F.coalesce(
            blank_to_null(F.col("rss.description")),
            blank_to_null(F.col("atom.summary")),
            F.col("atom.content"),
        )
    )
    rows = parsed.select(
        "source_key",
        "arrival",
        "publisher",
        "language",
        link.alias("url"),
        F.coalesce(blank_to_null(F.col("rss.guid")), blank_to_null(F.col("atom.id"))).alias("guid"),
        plain(F.coalesce("rss.title", "atom.title")).alias("t"),
        text.alias("s"),
        F.coalesce(
            _feed_date(F.col("rss.pubDate")),
            _feed_date(F.col("atom.published")),
            _feed_date(F.col("atom.updated")),
        ).alias("published_at"),
        F.coalesce("rss.author", "atom.author.name").alias("author"),
        F.to_json("rss.category").alias("tags"),
    ).filter(F.col("url") != "")
    return rows.select(
        "source_key",
        "arrival",
        F.coalesce("guid", "url").alias("external_id"),
        "url",
        _head(F.coalesce("t", "url"), title_limit).alias("title"),
        _head(F.col("s"), summary_limit).alias("summary"),
        _head(F.col("s"), excerpt_limit).alias("content_excerpt"),
        "published_at",
        "author",
        "publisher",
        "language",
        F.create_map(F.lit("tags"), F.col("tags")).alias("raw_metadata"),
    )


def _origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def remove_dot_segments(path: Column) -> Column:
    """``.`` and ``..`` resolved within an absolute path."""
    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.array_append(acc, s)),
    )
    slash = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), slash)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on ``base``."""
    directory = F.regexp_replace(_path(base), "[^/]*$", "")
    directory = F.when(directory == "", F.lit("/")).otherwise(directory)
    relative = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    whole = F.regexp_extract(base, r"^([^#]*)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(_origin(base), remove_dot_segments(relative), tail))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#"), F.concat(whole, href))
        .otherwise(
            F.concat(_origin(base), remove_dot_segments(F.concat(directory, relative)), tail)
        )
    )


def anchors(html: Column) -> Column:
    """``array<struct<href, text>>`` of the closed anchors of a page, in order."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>.*?</a\s*>"), F.lit(0))

    def link(a: Column) -> Column:
        tag = F.regexp_extract(a, r"(?is)^<a(\s[^>]*)>", 1)
        value = F.regexp_extract(tag, r"(?is)\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
        href = F.regexp_replace(value, r"^[\"']|[\"']$", "")
        text = F.regexp_replace(F.regexp_extract(a, r"(?is)^<a\s[^>]*>(.*)</a\s*>$", 1), "<[^>]+>", "")
        return F.struct(href.alias("href"), text.alias("text"))

    return F.filter(F.transform(raw, link), lambda k: k["href"] != "")


def listing_links(
    pages: DataFrame,
    section: Column | None = None,
    min_text: int = MIN_LINK_TEXT,
    max_links: int | None = None,
    title_limit: int | None = None,
) -> DataFrame:
    """Links of ``pages(page_id, url, html)`` that live under the page's section.

    Same host, path below the section but not the section itself, long enough
    anchor text, fragment dropped, first occurrence per address, all of them
    unless ``max_links`` per page are asked for.
    """
    base = pages.select(
        "page_id",
        F.col("url").alias("listing_url"),
        (F.regexp_replace(_path(F.col("url")), "/+$", "") if section is None else section).alias(
            "section"
        ),
        F.posexplode(anchors(F.col("html"))).alias("position", "a"),
    )
    # Unescaping may call the entity table, so it runs outside the lambda above.
    links = base.select(
        "page_id",
        "listing_url",
        "section",
        "position",
        unescape(F.col("a.href")).alias("href"),
        F.trim(F.regexp_replace(unescape(F.col("a.text")), f"{WS}+", " ")).alias("text"),
    ).withColumn("absolute", resolve_url(F.col("listing_url"), strip_ws(F.col("href"))))
    path = _path(F.col("absolute"))
    kept = links.filter(
        (_netloc(F.col("absolute")) == _netloc(F.col("listing_url")))
        & path.startswith(F.col("section"))
        & (F.regexp_replace(path, "/+$", "") != F.col("section"))
        & (F.length("text") >= min_text)
    ).withColumn("url", F.regexp_extract("absolute", "^([^#]*)", 1))
    # The first anchor of every address, as an aggregate per (page, address).
    first = kept.groupBy("page_id", "listing_url", "url").agg(
        F.min("position").alias("position"), F.min_by("text", "position").alias("title")
    )
    order = Window.partitionBy("page_id").orderBy("position")
    ranked = first.withColumn("rank", F.row_number().over(order))
    if max_links is not None:
        ranked = ranked.filter(F.col("rank") <= max_links)
    return ranked.select(
        "page_id",
        "listing_url",
        (F.col("rank") - 1).alias("arrival"),
        F.col("url").alias("external_id"),
        "url",
        _head(F.col("title"), title_limit).alias("title"),
        _netloc(F.col("listing_url")).alias("publisher"),
    )
