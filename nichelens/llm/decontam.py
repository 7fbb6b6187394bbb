"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Words are runs of anything but ASCII separators, A-Z lower-cased. The automaton's letters are words,
numbered over the benchmark's vocabulary, so a document is scanned once, word by word, whatever the
number of items; a hit's word positions are mapped to character offsets of the original text.

The benchmark is a query set: it reaches the tasks in blocks of at most ``BLOCK_WORDS`` words, each an
automaton of bounded size, and each block scans all documents in turn, carrying the hits along.

Null text has no words and is clean. An item without words (or null) has no window; items with equal
ids count once; an item without an id marks words, but is neither counted nor named. Every input row
gives one output row, repeated rows too; other columns are not read.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelens.llm.common import FOLD, slices, texts_of, with_id

BLOCK_WORDS = 200_000
WINDOW = 10


def windows(words: list[bytes], n: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Every run of ``n`` consecutive words; of fewer words, but not none, the one run there is."""
    if not words:
        return []
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


class Matcher:
    """The automaton of one block of items, with the vocabulary that numbers its letters."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            for window in windows(text.translate(FOLD).split(), n):
                key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
                found.setdefault(key, set()).update([item_id] if item_id is not None else [])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in found.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(ids))))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals [start, end) of all occurrences, and the items they come from."""
        if self.empty or not words:
            return [], set()
        get, spans, ids = self.number.get, [], set()
        for end, (length, names) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            spans.append((end + 1 - length, end + 1))
            ids.update(names)
        return spans, ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching intervals as one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def character_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word intervals as character offsets [start, end) of the original text."""
    folded = np.frombuffer(raw.translate(FOLD), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], folded.astype(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    leading = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(leading[starts[a]]), "end": int(leading[ends[b - 1]])} for a, b in spans]


_MATCHERS: dict[str, Matcher] = {}

_STATE = "text string, n_words long, hits array<struct<a:int,b:int>>, items array<string>"
_RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple[str | None, bytes]]]:
    """The items in blocks of bounded size, read one block at a time."""
    source = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    source = source.where("text IS NOT NULL")
    # A word and its separator take two bytes at least, so the length bounds the words.
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / 2 / BLOCK_WORDS))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    return [
        sorted(((r["id"], r["text"].encode()) for r in source.where(part == b).collect()), key=lambda x: (x[0] or "", x[1]))
        for b in range(count)
    ]


def scan(
    docs: DataFrame,
    items: DataFrame,
    n: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, items, spans) per document: hit words, item ids sorted as text, and the
    character spans of the hit passages in the original text."""
    blocks = _blocks(items, item_id_col, item_text_col)
    context = docs.sparkSession.sparkContext
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = state.schema["id"].dataType
    for number, block in enumerate(blocks):
        shared, first, last = context.broadcast(block), number == 0, number == len(blocks) - 1
        key = uuid.uuid4().hex

        def run(batches, shared=shared, first=first, last=last, key=key):
            if key not in _MATCHERS:
                _MATCHERS.clear()  # one automaton at a time
                _MATCHERS[key] = Matcher(shared.value, n)
            matcher = _MATCHERS[key]
            for part in slices(batches):
                texts = texts_of(part.column("text"))
                words, hits, names = [], [], []
                old = None if first else (part.column("hits").to_pylist(), part.column("items").to_pylist())
                for i, raw in enumerate(texts):
                    split = raw.translate(FOLD).split()
                    spans, ids = matcher.scan(split)
                    if old:
                        spans = spans + [(s["a"], s["b"]) for s in old[0][i]]
                        ids = ids.union(old[1][i])
                    words.append(len(split))
                    hits.append(merged(spans))
                    names.append(sorted(ids))
                columns = [part.column("id")]
                if last:
                    columns += [
                        pa.array(words, pa.int64()),
                        pa.array([sum(b - a for a, b in s) for s in hits], pa.int64()),
                        pa.array(names, pa.list_(pa.string())),
                        pa.array(
                            [character_spans(t, s) if s else [] for t, s in zip(texts, hits, strict=True)],
                            pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                        ),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_hit", "items", "spans"])
                else:
                    columns += [
                        part.column("text"),
                        pa.array(words, pa.int64()),
                        pa.array(
                            [[{"a": a, "b": b} for a, b in s] for s in hits],
                            pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])),
                        ),
                        pa.array(names, pa.list_(pa.string())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n_words", "hits", "items"])

        state = state.mapInArrow(run, with_id(kind, _RESULT if last else _STATE))
    return state.withColumnRenamed("id", id_col)


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of a scan."""
    return scanned.select(
        F.col(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
