"""Token counts by section: a document is encoded once, and its tokens are attributed by their offsets.

Token character spans are joined to sections by position (both are sorted, so each token is found by a
search among the section starts). A token that crosses a boundary goes by an explicit rule:

* ``first``: to the section that holds its first character;
* ``largest``: to the section that holds most of its characters, the earlier one of equals;
* ``split``: to each section by its share of the token's characters.

Characters are code points. A token that is part of a character's bytes (of a letter that the vocabulary
spells in several tokens) spans that character for its first token and nothing for the others, so every
token counts once. Sections must be sorted and must not overlap; tokens outside all of them count
nowhere. Null and empty texts have no tokens and, cut by lines, one empty section. Every row counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelens.llm.bpe import loaded
from nichelens.llm.common import slices, with_id

RULES = ("first", "largest", "split")


def token_spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character [start, stop) of tokens of the given byte lengths that make up ``raw``."""
    begins = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    count = np.concatenate(([0], np.cumsum(begins)))  # characters that begin before each byte
    ends = np.cumsum(lengths)
    return count[ends - lengths], count[ends]


def attribute(starts: np.ndarray, stops: np.ndarray, section_starts: np.ndarray, section_stops: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section (a float for ``split``) for sorted tokens and sorted, disjoint sections."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    total = np.zeros(len(section_starts))
    if not len(starts) or not len(section_starts):
        return total
    # A token within a character, which begins none, stands at the character before it.
    inside = np.where(stops > starts, starts, np.maximum(starts - 1, 0))
    first = np.searchsorted(section_starts, inside, side="right") - 1
    holds = (first >= 0) & (inside < section_stops[np.maximum(first, 0)])
    crossing = np.flatnonzero((stops > starts) & ~(holds & (stops <= section_stops[np.maximum(first, 0)])))
    plain = holds.copy()
    if rule != "first":
        plain[crossing] = False
    np.add.at(total, first[plain], 1)
    if rule == "first":
        return total
    for i in crossing:  # few: tokens over a boundary
        a, b = starts[i], stops[i]
        near = range(max(first[i], 0), int(np.searchsorted(section_starts, b, side="left")))
        shares = [(min(b, section_stops[s]) - max(a, section_starts[s]), s) for s in near]
        shares = [(x, s) for x, s in shares if x > 0]
        if not shares:
            continue
        if rule == "largest":
            total[max(shares, key=lambda x: (x[0], -x[1]))[1]] += 1
        else:
            for x, s in shares:
                total[s] += x / (b - a)
    return total


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """[start, stop) of each line with its line end; an empty text has one empty line."""
    lines = text.split("\n")
    sizes = np.array([len(x) + 1 for x in lines], dtype=np.int64)
    sizes[-1] -= 1
    stops = np.cumsum(sizes)
    return stops - sizes, stops


def count_lines(docs: DataFrame, path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, start_char, end_char, n_tokens) for every line of every whole text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType

    def run(batches):
        ranks, compiled = loaded(path, pattern)
        length = np.array(ranks.length)
        for part in slices(batches, 1 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            owner, number, starts, stops, counts = [], [], [], [], []
            for i, (text, packed) in enumerate(zip(texts, ranks.encode(texts, compiled), strict=True)):
                a, b = line_sections(text)
                at, to = token_spans(text.encode(), length[np.frombuffer(packed, "<i4")])
                owner.append(np.full(len(a), i))
                number.append(np.arange(len(a)))
                starts.append(a)
                stops.append(b)
                counts.append(attribute(at, to, a, b, rule))
            flat = [np.concatenate(x) for x in (owner, number, starts, stops, counts)]
            for begin in range(0, len(flat[0]), 1 << 16):
                cut = [x[begin : begin + (1 << 16)] for x in flat]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(cut[0])), pa.array(cut[1].astype(np.int32)), pa.array(cut[2], pa.int64()),
                        pa.array(cut[3], pa.int64()), pa.array(cut[4], pa.float64()),
                    ],
                    names=["id", "section", "start_char", "end_char", "n_tokens"],
                )

    counted = source.mapInArrow(run, with_id(kind, "section int, start_char long, end_char long, n_tokens double"))
    if rule != "split":
        counted = counted.withColumn("n_tokens", F.col("n_tokens").cast("long"))
    return counted.withColumnRenamed("id", id_col)
