"""Identity keys of documents: address, content, wording."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from nichelens.functions.normalize import blank_to_null, let, strip_ws

# Query parameters that name a campaign, not a page.
TRACKING_PARAMS = (
    "fbclid",
    "gclid",
    "igshid",
    "mc_cid",
    "mc_eid",
    "msclkid",
    "ref",
    "ref_src",
    "referrer",
    "source",
    "spm",
    "yclid",
    "_hsenc",
    "_hsmi",
)
READER_TRACKING_PREFIXES = ("utm_", "yclid", "gclid", "fbclid", "from", "ref")
# Words that carry no topic.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have",
    "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were",
    "will", "with", "you", "your", "we", "our", "new", "now",
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то",
    "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же", "вы", "за",
    "бы", "по", "только", "ее", "мне", "было", "вот", "от", "для", "или",
)
WORD = "[0-9a-zıа-яё]+"
MIN_TOKENS = 5

# Characters beyond ASCII that NFKC leaves alone; text made only of these and
# ASCII is already normal and never leaves the JVM.
NFKC_STABLE = (
    r"¡-§©«¬®°±¶·»¿"
    r"À-ıĴ-ľŁ-ňŊ-žЀ-҂Ҋ-ԯ"
    r"‐‒-―‘-„†-•€"
)
_WS_RUN = re.compile(r"\s+")


def _nfkc_fold(value: str) -> str:
    return _WS_RUN.sub(" ", unicodedata.normalize("NFKC", value))


@F.pandas_udf(StringType())
def _nfkc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(_nfkc_fold, na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC form, with unusual spaces already plain.

    Spark has no built-in, so texts with an unstable character (only) go
    through Arrow. ASCII is passed over with one comparison per character.
    """
    unstable = c.rlike(f"[^\\x00-\\x7F](?<![{NFKC_STABLE}])")
    return F.coalesce(_nfkc_batch(F.when(unstable, c)), c)


# After NFKC only ASCII spaces are left; single blanks need no replacement.
_SPACE_RUN = r"[\t-\r\x1c-\x1f][\t-\r\x1c-\x20]*|\x20[\t-\r\x1c-\x20]+"


def fold_text(c: Column) -> Column:
    """Lower-case with single spaces, for text that went through :func:`nfkc`."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _SPACE_RUN, " "))


def normalize_text(c: Column) -> Column:
    """NFKC, lower-case, single spaces; NULL becomes the empty string."""
    return fold_text(nfkc(c))


def _url_parts(url: Column) -> dict[str, Column]:
    # Every text fits: what is no scheme or host is path.
    shape = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    names = ("scheme", "netloc", "path", "query")
    return {name: F.regexp_extract(url, shape, i) for i, name in enumerate(names, start=1)}


def _query_pairs(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda pair: pair != "")


def _decoded(part: Column) -> Column:
    # A percent sign that begins no code stands for itself.
    return F.coalesce(F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25")), part)


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize_url(c: Column) -> Column:
    """Comparable address, or NULL when there is none.

    Scheme and host lower-cased, ``www.``, default port, fragment, tracking and
    blank parameters dropped, the remaining parameters sorted. A text without a
    usable scheme or host stays apart as a path of its own. An unclosed bracket
    or a port that is no number up to 65535 makes the address NULL.
    """
    def absolute(text: Column) -> Column:
        url = F.when(F.contains(text, F.lit("://")), text).otherwise(
            F.concat(F.lit("https://"), text)
        )
        return F.when(text != "", url)

    def split(url: Column) -> Column:
        parts = _url_parts(url)
        return F.struct(
            F.lower(parts["scheme"]).alias("scheme"),
            F.regexp_extract(F.lower(parts["netloc"]), r"([^@]*)$", 1).alias("authority"),
            parts["path"].alias("path"),
            _kept_params(parts["query"]).alias("params"),
        )

    def rebuilt(part: Column) -> Column:
        authority = part["authority"]
        scheme = F.when(part["scheme"] == "", F.lit("https")).otherwise(part["scheme"])
        bracketed = F.contains(authority, F.lit("["))
        name = F.when(bracketed, F.regexp_extract(authority, r"\[([^\]]*)", 1)).otherwise(
            F.regexp_extract(authority, r"^([^:]*)", 1)
        )
        host = F.regexp_replace(name, r"^www\.", "")
        stated = F.when(bracketed, F.regexp_extract(authority, r"\][^:]*:(.*)$", 1)).otherwise(
            F.regexp_extract(authority, r"^[^:]*:(.*)$", 1)
        )
        broken = (
            (bracketed != F.contains(authority, F.lit("]")))
            | ((stated != "") & ~stated.rlike(r"^0*[0-9]{1,5}$"))
            | (F.coalesce(stated.try_cast("bigint"), F.lit(0)) > 65535)
        )
        port = F.ltrim(stated, F.lit("0"))
        usual = F.when(scheme == "http", F.lit("80")).otherwise(F.lit("443"))
        known = scheme.isin("http", "https") & (port == usual)
        path = F.when(part["path"] == "/", part["path"]).otherwise(
            F.regexp_replace(part["path"], "/+$", "")
        )
        rooted = (path == "") | F.startswith(path, F.lit("/"))
        whole = F.concat(
            scheme,
            F.lit("://"),
            host,
            F.when((port == "") | known, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
            F.when(rooted, F.lit("")).otherwise(F.lit("/")),
            F.when(part["path"] == "", F.lit("/")).otherwise(path),
            F.when(F.size(part["params"]) == 0, F.lit("")).otherwise(
                F.concat(F.lit("?"), _encoded_params(part["params"]))
            ),
        )
        return F.when(~broken, whole)

    return let(let(let(strip_ws(c), absolute), split), rebuilt)


def _pair_struct(pair: Column) -> Column:
    return F.struct(
        _decoded(F.substring_index(pair, "=", 1)).alias("key"),
        _decoded(F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
    )


def _kept_params(query: Column) -> Column:
    return F.array_sort(
        F.filter(
            F.transform(_query_pairs(query), _pair_struct),
            lambda p: (p["value"] != "")
            & ~F.lower(p["key"]).isin(*TRACKING_PARAMS)
            & ~F.lower(p["key"]).startswith("utm_"),
        )
    )


def _encoded_params(params: Column) -> Column:
    return F.array_join(
        F.transform(
            params, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))
        ),
        "&",
    )


def url_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def content_fingerprint(*normalized_parts: Column) -> Column:
    """SHA-256 over already normalized parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in normalized_parts]), 256)


def tokenize(normalized: Column) -> Column:
    """Words of at least two characters without stopwords; repeats are kept."""
    words = F.regexp_extract_all(normalized, F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


_LANES = 0x0000000100000001
#: Tokens whose votes are counted together; bounds what a task holds, never the result.
VOTE_TOKENS = 1 << 20


def _lane_votes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``batch`` with ``token_count`` and 32 lanes instead of its last column, the tokens."""
    tokens = batch.column(batch.num_columns - 1)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), dtype=np.int64)
    # Each distinct token is hashed once.
    coded = tokens.flatten().dictionary_encode()
    digests = b"".join(hashlib.md5(t).digest()[:8] for t in coded.dictionary.cast(pa.binary()).to_pylist())
    known = np.asarray(pc.is_valid(coded.indices))
    codes = np.asarray(pc.fill_null(coded.indices, 0), dtype=np.int64)
    if known.any():
        h = np.where(known, np.frombuffer(digests, dtype=">u8").astype(np.uint64)[codes], np.uint64(0))
    else:
        h = np.zeros(len(codes), dtype=np.uint64)
    some = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[some]

    def per_row(values: np.ndarray) -> pa.Array:
        sums = np.zeros(batch.num_rows, dtype=np.int64)
        if len(some):
            sums[some] = np.add.reduceat(values.astype(np.int64), starts)
        return pa.array(sums)

    lanes = [per_row((h >> np.uint64(i)) & np.uint64(_LANES)) for i in range(32)]
    return pa.RecordBatch.from_arrays(
        [*batch.columns[:-1], per_row(known), *lanes],
        names=[*batch.schema.names[:-1], "token_count", *[f"lane{i}" for i in range(32)]],
    )


def _votes(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0), dtype=np.int64)
        part = np.cumsum(lengths) // VOTE_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            yield _lane_votes(batch.slice(start, stop - start))


def simhash_table(df: DataFrame, key: str, tokens: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *carried, simhash, token_count)`` for every row of ``df``.

    One vote per token occurrence and bit, top 64 bits of md5 as the token hash;
    a bit is set when its votes are positive, no tokens give 0. Bit ``i`` and
    bit ``i + 32`` are counted together in the two halves of one long (a Spark
    string cannot hold 2^31 tokens, so a half never overflows): 32 sums instead
    of 64. The tokens of a row are counted where the row is, by Arrow batch, and
    each row costs one small shuffle record however long its text is; rows of one
    key add their votes. Other columns of a row can be ``carried`` along, which
    spares a join and a second pass over its text.
    """
    rows = df.select(key, *carried, tokens)
    counts = [StructField(name, LongType()) for name in ("token_count", *[f"lane{i}" for i in range(32)])]
    votes = (
        rows.mapInArrow(_votes, StructType([*rows.schema.fields[:-1], *counts]))
        .groupBy(key, *carried)
        .agg(*[F.sum(field.name).alias(field.name) for field in counts])
    )
    ones = [F.col(f"lane{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(32)]
    ones += [F.shiftrightunsigned(f"lane{i}", 32) for i in range(32)]
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    word = zero
    for position, count in enumerate(ones):
        majority = count * 2 > F.col("token_count")
        word = word.bitwiseOR(F.when(majority, F.shiftleft(one, position)).otherwise(zero))
    return votes.select(key, *carried, word.alias("simhash"), "token_count")


def normalize_domain(url: Column) -> Column:
    """Host without user, port and ``www.``; NULL when empty."""
    absolute = F.when(F.contains(url, F.lit("//")), url).otherwise(
        F.concat(F.lit("https://"), url)
    )
    netloc = F.lower(F.regexp_extract(absolute, r"^(?:[^/?#]*:)?//([^/?#]*)", 1))
    host = F.regexp_extract(netloc, r"([^@]*)$", 1)
    host = F.regexp_extract(host, r"^([^:]*)", 1)
    return blank_to_null(F.regexp_replace(host, r"^www\.", ""))


def domain_suffixes(domain: Column) -> Column:
    """Every dot-suffix of a host, so that a subdomain test becomes an equality."""
    labels = F.split(domain, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def audience_can_open(url: Column, reachable: tuple[str, ...] | list[str]) -> Column:
    """Host equals or lies under one of the reachable domains; unknown is no."""
    suffixes = domain_suffixes(normalize_domain(url))
    allowed = F.array(*[F.lit(d) for d in reachable]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(suffixes, allowed), F.lit(False))


def strip_tracking(url: Column) -> Column:
    """Drop reader-tracking parameters by name prefix; order and blanks stay."""
    shape = r"(?s)^([^?#]*)(?:\?([^#]*))?(#.*)?$"
    head = F.regexp_extract(url, shape, 1)
    query = F.regexp_extract(url, shape, 2)
    fragment = F.coalesce(F.regexp_extract(url, shape, 3), F.lit(""))

    def untracked(p: Column) -> Column:
        tracked = F.lit(False)
        for prefix in READER_TRACKING_PREFIXES:
            tracked = tracked | F.lower(p["key"]).startswith(prefix)
        return ~tracked

    kept = _encoded_params(F.filter(F.transform(_query_pairs(query), _pair_struct), untracked))
    tail = let(
        kept, lambda k: F.when(k == "", F.lit("")).otherwise(F.concat(F.lit("?"), k))
    )
    return F.when(query == "", url).otherwise(F.concat(head, tail, fragment))
