"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelens.llm import (
    align,
    bpe,
    decontam,
    langid,
    licenses,
    lm,
    neardup,
    phrases,
    repeats,
    simhash,
    tokencount,
    urlfilter,
    warc,
)
from nichelens.llm.common import held_out, table

#: Where the vocabulary lies; another file of ranks may be given.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: The two vocabularies that are aligned.
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    return lm.scores(docs, held_out(F.col("doc_id"), 7, 2))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, decoded again; one row per row of documents."""
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, a crossing token counted where it begins."""
    return tokencount.count_lines(table(spark, sf_dir, "documents"), RANKS, PATTERN, rule="first")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document; one of each class is kept."""
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page: by rule, else by the links of its host."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document is left when strings of earlier documents are cut."""
    left = repeats.remove(table(spark, sf_dir, "documents"))
    return left.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


# Two hexadecimal digits a byte, so that bytes can be taken and joined as text.
OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
    SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS g
    FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS s FROM d)),
least_id AS (SELECT g, min(doc_id) AS low, max(doc_id) AS high FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
dup AS (SELECT doc_id, s FROM win JOIN least_id USING (g) WHERE doc_id > low),
gone AS (
    SELECT doc_id, s, e, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span
    FROM (SELECT doc_id, s, s + 50 AS e,
                 CASE WHEN s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50, -1) THEN 1 ELSE 0 END AS fresh
          FROM dup)),
spans AS (SELECT doc_id, span, min(s) AS a, max(e) AS b FROM gone GROUP BY 1, 2),
kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY from_) AS k
    FROM (SELECT d.doc_id, h, 0 AS from_, coalesce(min(a), length(any_value(h)) // 2) AS to_
          FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id, h
          UNION ALL
          SELECT doc_id, h, b, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), length(h) // 2)
          FROM spans JOIN d USING (doc_id))
    GROUP BY 1),
told AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id)
"""


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and the next document, compared."""
    return simhash.compare_edits(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a window of a benchmark item."""
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.report(found)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    found = langid.predict(docs, net)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of a content-addressed archive, written and read back."""
    read = warc.archive_pages(spark, table(spark, sf_dir, "pages"), f"warc-{uuid.uuid4().hex}")
    kind = warc.field(F.col("header"), "WARC-Type").alias("record_type")
    return read.select("page_id", "payload_bytes", "payload_digest", kind, "refers_to")


# A SHA-1 digest in base32: 40 hexadecimal digits, five of them to four signs.
OP11_SQL = """
WITH d AS (
    SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS k,
             first(page_id) OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS low FROM d)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER), 1)), '')
           AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN low END AS refers_to
FROM r
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return phrases.mine(table(spark, sf_dir, "documents"), least=100, longest=5, covered=100, top=2000)


OP12_SQL = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM d),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
grams AS (
    SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS g
    FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, range(1, 6) t(s) WHERE len(w) >= s)),
f AS (SELECT lang, s, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
    SELECT f.lang, g, s, f AS a, k, array_to_string(string_split(g, ' ')[:k], ' ') AS g1, array_to_string(string_split(g, ' ')[k + 1:], ' ') AS g2
    FROM f, range(1, 5) t(k) WHERE k < s),
scored AS (
    SELECT c.lang, c.g AS phrase, c.s, c.a, x.f AS l, y.f AS r, n, k,
           CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g1 JOIN f y ON y.lang = c.lang AND y.g = c.g2 JOIN total t ON t.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
    SELECT DISTINCT i.lang, i.phrase FROM worst i JOIN f o ON o.lang = i.lang AND o.s > i.s AND 100 * o.f >= 100 * i.a
    WHERE contains(' ' || o.g || ' ', ' ' || i.phrase || ' '))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst ANTI JOIN held USING (lang, phrase)
QUALIFY rank <= 2000
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, with corpus-wide counts of the linked pairs."""
    return align.align(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


_WORDS_SQL = r"""
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (
    SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN win USING (k, g)),
words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY 1),
named AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
    FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_bpe": op2_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_licenses": op5_licenses,
    "op6_url_filter": op6_url_filter,
    "op7_repeats": op7_repeats,
    "op8_fingerprints": op8_fingerprints,
    "op9_decontamination": op9_decontamination,
    "op10_language": op10_language,
    "op11_warc": op11_warc,
    "op12_phrases": op12_phrases,
    "op13_alignment": op13_alignment,
}

#: SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op7_repeats": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_warc": OP11_SQL,
    "op12_phrases": OP12_SQL,
}
