"""What the removal of repeated strings leaves on disk, and which segments meet."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from nichelens import session
from nichelens.llm import repeats


def test_only_the_spans_are_left_on_disk(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = letters(90)
    rows = [(1, letters(200) + shared), (2, letters(150) + shared + letters(60)), (3, letters(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    plain = {x.doc_id: bytes(x.kept) for x in repeats.remove(docs).collect()}
    row = docs.select(F.struct("doc_id", "text").alias("row"), "doc_id")
    inside = {x.row.doc_id: bytes(x.kept) for x in repeats.remove(row, text_col="row.text", row_col="row").collect()}
    assert plain == inside == {i: t.replace(shared, "" if i == 2 else shared).encode() for i, t in rows}
    assert {name.split("-")[0] for name in os.listdir(tmp_path)} == {"repeats"}


def test_short_strings_in_common_do_not_make_segments_meet():
    """Texts with 18 bytes in common at many places, and no window, have no segment that must travel."""
    r = random.Random(9)
    letters = lambda n: bytes(r.randrange(1, 256) for _ in range(n))
    pieces = [letters(18) for _ in range(200)]
    anchors = []
    for _ in range(2):
        text = b"".join(letters(40) + p for p in pieces)
        buffer = np.frombuffer(text, dtype=np.uint8)
        anchors.append(set(repeats._segments(buffer, np.full(len(text), len(text)), 50)[2].tolist()))
    assert not anchors[0] & anchors[1]
