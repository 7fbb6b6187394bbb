"""Plain text out of HTML fragments."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nichelens.functions.normalize import WS, blank_to_null, let

# The entities nearly all feeds stop at; anything else takes the full table.
COMMON_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


@F.pandas_udf(StringType())
def _unescape_batch(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


#: References up to their semicolon.
_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][0-9A-Za-z]*);")


def _closed_reference(found: re.Match) -> str:
    known = found[1].startswith("#") or f"{found[1]};" in html5
    return html.unescape(found[0]) if known else found[0]


@F.pandas_udf(StringType())
def _unescape_closed_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: _CLOSED.sub(_closed_reference, text), na_action="ignore")


def unescape(c: Column, closed: bool = False) -> Column:
    """Character references to characters; unusual ones go through the full entity table.

    ``closed`` leaves those without a semicolon as they stand, so that a text cut within
    one keeps what is left of it; else names that HTML knows without one are resolved too.
    """
    simple = "|".join(e[1:] for e in [*COMMON_ENTITIES, "&amp;"])
    unusual = c.rlike(rf"&(?!(?:{simple}))")
    plain = c
    for entity, character in COMMON_ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    plain = F.replace(plain, F.lit("&amp;"), F.lit("&"))
    batch = _unescape_closed_batch if closed else _unescape_batch
    return F.when(unusual, batch(F.when(unusual, c))).otherwise(plain)


def strip_html(c: Column, closed: bool = False) -> Column:
    """Tags to spaces, references resolved, spaces collapsed; blank becomes NULL."""
    text = unescape(F.regexp_replace(c, "<[^>]+>", " "), closed)
    return let(F.trim(F.regexp_replace(text, f"{WS}+", " ")), blank_to_null)
