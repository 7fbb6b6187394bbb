"""The archive, phrase mining and tokenizer alignment against plain Python."""

import base64
import hashlib
import json
import re
from collections import Counter, defaultdict
from itertools import islice

import pytest
import sentencepiece
from odd_rows import document_rows, page_rows, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nichelens.llm import align, phrases, warc
from nichelens.llm.common import LOWER
from nichelens.llm.queries import BYTE_LEVEL, PIECES, QUERIES


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


# --- 11: archive ---------------------------------------------------------------------------------


def archived(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for body, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for k, i in enumerate(sorted(ids, key=lambda x: (x is None, x))):
            low = min((x for x in ids if x is not None), default=None)
            out.append((i, len(body), digest, "revisit" if k else "response", low if k else None))
    return in_order(out)


def test_archive_query(spark, odd_tables):
    found = QUERIES["op11_warc"](spark, odd_tables).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert in_order(tuple(r) for r in found.collect()) == archived(page_rows())


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_hot_payload_and_lengths(spark, tmp_path):
    rows = [(i, f"http://h/{i % 7}", "same" if i % 3 else f"own {i}\r\n\r\nx\r\n") for i in range(3000, 0, -1)] + [(None, None, "same"), (5, "http://h/5", "own 5")]
    archive = warc.store(pages(spark, rows).repartition(5), str(tmp_path / "a"))
    assert spark.read.parquet(archive.payloads).count() == len({h for *_, h in rows})
    found = warc.restore(spark, archive)
    got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert in_order(tuple(r) for r in got) == archived(rows)
    whole = warc.whole(found).select("header", "http_header", "payload", "record", "record_type").collect()
    for r in whole:
        length = int(re.search(rb"Content-Length: (\d+)", r.header)[1])
        assert len(r.record) == len(r.header) + length + 4
    ids = [re.search(rb"WARC-Record-ID: <(.*)>", r.header)[1] for r in whole]
    assert len(set(ids)) == len(rows)
    targets = {re.search(rb"WARC-Record-ID: <(.*)>", r.header)[1] for r in whole if r.record_type == "response"}
    assert {re.search(rb"WARC-Refers-To: <(.*)>", r.header)[1] for r in whole if r.record_type == "revisit"} <= targets


def test_short_payloads_are_not_shared(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    found = warc.restore(spark, warc.store(pages(spark, rows), str(tmp_path / "a"), least_bytes=3)).collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in found} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_files_round_trip(spark, tmp_path):
    awkward = ["", "\r\n\r\n", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "x\r\n", "é\r", "\n\n\n", "y" * 70_000 + "\r\n\r\n" * 9, None]
    rows = [(i, "http://h/\r\nX-Bad: 1" if i == 2 else f"http://h/{i}", h) for i, h in enumerate(awkward)] + [(90, None, "x\r\n")]
    found = warc.restore(spark, warc.store(pages(spark, rows), str(tmp_path / "a")))
    warc.write_files(found, str(tmp_path / "files"))
    back = warc.read_files(spark, str(tmp_path / "files")).collect()
    want = Counter((bytes(r.header), bytes(r.http_header), b"" if r.record_type == "revisit" else bytes(r.payload)) for r in found.collect())
    assert Counter((bytes(r.header), bytes(r.http_header), bytes(r.payload)) for r in back) == want
    assert not any(b"\nX-Bad" in r.header for r in back)


def test_broken_archives_raise(spark, tmp_path):
    archive = warc.store(pages(spark, [(1, "u", "abc"), (2, "u", "abd")]), str(tmp_path / "a"))
    wrong = spark.read.parquet(archive.payloads).withColumn("payload", F.lit("abx").cast("binary"))
    wrong.write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(Exception, match="does not fit its digest"):
        warc.restore(spark, warc.Archive(archive.headers, str(tmp_path / "wrong"))).collect()
    (tmp_path / "cut.warc").write_bytes(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="cut off"):
        warc.read_files(spark, str(tmp_path / "cut.warc")).collect()


# --- 12: phrases ---------------------------------------------------------------------------------


def plain_phrases(rows, least, longest=5, covered=100, top=2000):
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()
            )
            if not inside:
                kept.append((-score, -a, b" ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(islice(sorted(kept), top), 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return in_order(out)


def phrase_rows():
    rows = [(t, g) for _, t, g, *_ in document_rows()]
    few = "ab cd\tef Gh, of the sea\x0bof the sea; \x01 \x1c x"
    rows += [(f"{few} {prose(s, 30, ('a', 'b', 'c'))}\n{few}", "en" if s % 3 else None) for s in range(40)]
    return rows + [("of the sea " * 50, "en"), ("A.a a,b" * 20, "la\tng x"), ("ö ö ö", "und")]


@pytest.mark.parametrize("least,covered,top,trie", [(3, 100, 2000, {}), (2, 60, 7, {"held": 40, "container": 3}), (5, 100, None, {"held": 10, "container": 1})])
def test_phrases(spark, least, covered, top, trie):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit(1)).repartition(3)
    found = phrases.mine(docs, least=least, covered=covered, top=top, **trie)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_phrases(rows, least, covered=covered, top=top)
    assert in_order(tuple(r) for r in found.collect()) == want and len(want) > 20


def test_phrase_products_beyond_64_bits(spark):
    grams = [("en", "a", 1, 4 * 10**12), ("en", "b", 1, 3 * 10**12), ("en", "a b", 2, 2 * 10**12 + 1)]
    frame = spark.createDataFrame(grams, "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10**14 + 7)], "lang string, n long")
    row = phrases.scored_cuts(frame, totals).first()
    assert row.score == 1000 * (2 * 10**12 + 1) * (10**14 + 7) // (12 * 10**24)


def test_trie_leaves_whole_subtrees():
    import numpy as np

    trie, want = phrases.Trie(container=2), Counter()
    r = np.random.default_rng(1)
    for _ in range(20):
        first, rest = r.integers(1, 5, 50), r.integers(0, 4, (50, 3))
        want.update(zip(first.tolist(), map(tuple, rest.tolist()), strict=True))
        trie.add(first, np.ascontiguousarray(rest.astype(">i4")).view("V12")[:, 0])
    assert trie.total == len(want) and any(type(n) is dict for n in trie.root.values())
    got, words = Counter(), []
    for word, keys, counts in trie.leave(0):
        assert keys == sorted(keys) and word not in words
        words.append(word)
        for key, n in zip(keys, counts, strict=True):
            got[word, tuple(np.frombuffer(key, ">i4").tolist())] += n
    assert got == want and trie.total == 0


# --- 13: alignment -------------------------------------------------------------------------------


def plain_alignment(rows):
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sign = align._byte_level()
    entry = {n: e for e, n in json.load(open(BYTE_LEVEL, encoding="utf-8"))["model"]["vocab"].items()}
    told, pairs = [], Counter()
    for i, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bytes_a = [bytes(sign[c] for c in entry[t]) for t in x]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) and b.is_byte(t) else p.replace("▁", " ").encode() for t in y for p in [b.id_to_piece(t)]]
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            told.append((i, [], [], [], ""))
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, side = 0, {}
            for k, p in enumerate(parts):
                at += len(p)
                side[at] = k
            ends.append(side)
        links, groups, last = [], [], (0, 0)
        for e in sorted(ends[0].keys() & ends[1].keys()):
            p, q = ends[0][e], ends[1][e]
            links.append((x[p], y[q]))
            groups.append(",".join(map(str, x[last[0] : p + 1])) + "|" + ",".join(map(str, y[last[1] : q + 1])))
            last = (p + 1, q + 1)
        pairs.update(links)
        told.append((i, x, y, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, t), n in pairs.items():
        top[t] = max(top[t], n)
    return in_order(
        (i, len(x), len(y), len(links), len(links), sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links), sha) for i, x, y, links, sha in told
    )


def test_alignment(spark, odd_tables):
    found = QUERIES["op13_alignment"](spark, odd_tables)
    got = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert in_order(tuple(r) for r in got) == plain_alignment([(i, t) for i, t, *_ in document_rows()])


def test_alignment_odd_texts(spark):
    texts = ["<s> </s> <unk><0x41><|endoftext|>", "▁a ▁", "  two  blanks ", "\n\t\r\n", "ﬁ ligature ½", "\x00\x01", "क्षि नमस्ते", "a" * 5000, "é", "﻿bom"] + ["same text"] * 9
    rows = list(enumerate(texts)) + [(3, "same text"), (None, "same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("x")).repartition(4)
    got = align.align(docs, BYTE_LEVEL, PIECES).collect()
    assert in_order(tuple(r) for r in got) == plain_alignment(rows)


def test_dense_bitmaps_and_pairs(spark):
    rows = [(i, "a b" if i % 10 else "a b a b a b") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    table = {(r.a, r.b): (r.n_docs, r.n_links) for r in align.pairs(docs, BYTE_LEVEL, PIECES).collect()}
    assert set(table.values()) == {(9000, 9000 + 2 * 900)} and len(table) == 2
    got = align.align(docs, BYTE_LEVEL, PIECES).collect()
    assert in_order(tuple(r) for r in got) == plain_alignment(rows)
