"""The operators' parts against plain models."""

import random

import numpy as np
import pytest
import regex
import tiktoken
from odd_rows import prose
from pyspark.sql import functions as F

from nichelens.llm import bpe, decontam, langid, licenses, lm, neardup, repeats, simhash, tokencount
from nichelens.llm.common import FOLD, LOWER, components
from nichelens.llm.queries import PATTERN, RANKS
from nichelens.llm.suffix_array import permuted_common_prefixes, suffix_array


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(RANKS)


def test_suffix_array_and_prefixes():
    r = random.Random(2)
    for _ in range(300):
        n, k = r.randrange(0, 60), r.choice([1, 2, 3, 5, 200])
        text = bytes(1 + r.randrange(k) for _ in range(n))
        array = suffix_array(np.frombuffer(text, dtype=np.uint8))
        assert array.tolist() == sorted(range(n), key=lambda i: text[i:])
        common = permuted_common_prefixes(np.frombuffer(text, dtype=np.uint8), array, 20)
        for before, i in zip(array[:-1].tolist(), array[1:].tolist(), strict=True):
            c = 0
            while c < 20 and max(i, before) + c < n and text[i + c] == text[before + c]:
                c += 1
            assert common[i] == c


def test_bpe_random_texts(ranks):
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    r = random.Random(1)
    blocks = [(32, 127), (0x80, 0x3000), (0x1F300, 0x1F600), (9, 33), (32, 33)]
    texts = ["".join(chr(r.randrange(*r.choice(blocks))) for _ in range(r.randrange(400))) for _ in range(150)]
    texts += ["a" * 3000, "日本語" * 300, "ab" * 2000, "x!?" * 900, "\n \nb \n b", "a\x1c b\x85 d  "]
    found = ranks.encode(texts, regex.compile(PATTERN))
    assert [np.frombuffer(x, "<i4").tolist() for x in found] == [encoding.encode_ordinary(t) for t in texts]


def test_decode_ignores_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [0, 999_999, -1, None]), (2, None), (3, [])], "doc_id int, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(rows, RANKS).collect()}
    assert len(got[1]) == 1 and got[2] == got[3] == b""


def test_token_rules():
    starts, stops = np.array([0, 2, 5]), np.array([2, 5, 6])
    sections = np.array([0, 4]), np.array([4, 6])
    assert tokencount.attribute(starts, stops, *sections, "first").tolist() == [2, 1]
    assert tokencount.attribute(starts, stops, *sections, "largest").tolist() == [2, 1]
    assert tokencount.attribute(starts, stops, *sections, "split") == pytest.approx([1 + 2 / 3, 1 + 1 / 3])
    gap = np.array([1, 5]), np.array([2, 6])
    assert tokencount.attribute(starts, stops, *gap, "first").tolist() == [0, 1]
    assert tokencount.attribute(starts, stops, *gap, "largest").tolist() == [1, 1]
    with pytest.raises(ValueError):
        tokencount.attribute(starts, stops, *gap, "other")


def test_dart_signatures_estimate_similarity():
    words = prose(1, 400).encode().split()
    near = list(words)
    near[100] = b"zz"
    near[300] = b"zz"
    owner, value = neardup.element_sets([b" ".join(words), b" ".join(near), prose(2, 5).encode()])
    sets = [set(value[owner == i].tolist()) for i in range(2)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    signature = neardup.dart_signatures(owner, value, 3, 1500)
    assert (signature[0] == signature[1]).mean() == pytest.approx(exact, abs=0.03)
    assert len(np.unique(signature[2])) == 1 and (signature != 0).all()


def test_counted_elements_keep_levels():
    owner, value = neardup.element_sets([b"a b c d e a b c d e a b c d e"], counted=True)
    _, plain = neardup.element_sets([b"a b c d e a b c d e a b c d e"])
    assert len(value) == len(set(value.tolist())) == 11 and len(plain) == 5


def test_classes_join_through_later_rounds(spark):
    """A chain of near copies, each close to the next only, is one class."""
    base = prose(5, 200).split()
    rows, text = [], list(base)
    for i in range(12):
        rows.append((100 - i, " ".join(text)))
        text = list(text)
        text[10 * i + 20] = f"new{i}"
        text[10 * i + 25] = f"newer{i}"
    rows += [(i, prose(50 + i, 80)) for i in range(5)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[100 - i] for i in range(12)} == {89} and all(got[i] == i for i in range(5))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                changed = True
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: y for x, y in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_near_fingerprints(spark):
    r = random.Random(4)
    values = [r.getrandbits(128) for _ in range(40)]
    for v in list(values):
        for bits in (1, 5, 6, 7, 9):
            w = v
            for b in r.sample(range(128), bits):
                w ^= 1 << b
            values.append(w)
    rows = spark.createDataFrame([(f"{v:032x}",) for v in [*values, values[0]]], "fingerprint string")
    want = {(a, b): (a ^ b).bit_count() for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= 6}
    got = {(int(x.a, 16), int(x.b, 16)): x.distance for x in simhash.near(rows, radius=6).collect()}
    assert got == want and len(want) > 100


def test_license_notice_with_changed_words(spark):
    notice = next(t.text for t in licenses.MORE if t.label == "mit-text").split()
    changed = [*notice[:15], "and", "or", *notice[15:30], *notice[31:]]
    rows = [(1, "x " * 5 + " ".join(notice)), (2, " ".join(changed)), (3, " ".join(notice[:8])), (4, "free of charge to any person")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].labels == "mit-text" and got[1].score == 1.0 and got[1].spans[0]["first"] == 5
    assert got[2].labels == "mit-text" and 0.5 <= got[2].score < 1 and len(got[2].spans) == 1
    assert got[3].labels == got[4].labels == "" and got[3].score == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [(f"i{k}", prose(100 + k, 12)) for k in range(9)]
    docs = [(k, prose(200 + k, 20) + " " + items[k][1] + " é, " + items[8 - k][1]) for k in range(9)]
    a, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string")
    whole = {r.doc_id: r for r in decontam.scan(a, b).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    parts = {r.doc_id: r for r in decontam.scan(a, b).collect()}
    assert whole == parts and all(len(r["items"]) >= 1 for r in whole.values())
    text = docs[0][1]
    hit = " ".join(text[s["start"] : s["end"]] for s in whole[0].spans)
    assert items[0][1].split()[0] in hit and items[8][1].split()[-1] in hit


def test_repeats_of_crowded_anchors(spark, monkeypatch):
    """The ways for few and for many segments of an anchor give the same result."""
    passage = prose(7, 30)
    docs = [(k, prose(300 + k, 6) + " " + passage + " " + prose(400 + k, 6)) for k in range(25)]
    docs.append((30, "é" * 9000 + passage * 3))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    few = sorted(map(tuple, repeats.remove(rows).collect()))
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 500)
    monkeypatch.setattr(repeats, "BLOCK", 4000)
    assert sorted(map(tuple, repeats.remove(rows).collect())) == few
    assert sum(r[2] for r in few) > 24 * (len(passage.encode()) - 1)


def test_language_network_learns():
    sample = [(lang, prose(k, 30, words).encode().translate(LOWER)[at : at + 64]) for lang, words in (("a", ("th", "er", "ing ")), ("b", ("ung", "ch ", "ei")), ("c", ("ció", "ar ", "os"))) for k in range(40) for at in (0, 20)]
    net = langid.train(sample, ["a", "b", "c"])
    texts = [prose(900 + k, 40, words).encode() for words in (("th", "er", "ing "), ("ung", "ch ", "ei"), ("ció", "ar ", "os")) for k in range(10)]
    assert (langid._pooled(net, texts).argmax(axis=1) == np.repeat([0, 1, 2], 10)).mean() >= 0.95
    assert langid._pooled(net, texts).sum(axis=1) == pytest.approx(1, abs=1e-4)


def test_gradients_of_the_network():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (6, 3))
    table, state = rng.normal(0, 1, (256, 24)).astype(np.float64), rng.normal(0, 1, (24, 8)).astype(np.float64)
    weight = rng.normal(0, 1, (6, 8, 3))

    def loss(t, s):
        return float((langid.run_direction(codes, t, s)[0][1:] * weight).sum())

    hidden, held = langid.run_direction(codes, table, state, keep=True)
    d_table, d_state = langid.back_direction(codes, table, state, hidden, held, weight)
    for grad, base, which in ((d_table, table, 0), (d_state, state, 1)):
        for _ in range(12):
            at = (codes[rng.integers(6), rng.integers(3)], rng.integers(24)) if which == 0 else (rng.integers(24), rng.integers(8))
            up, down = base.copy(), base.copy()
            up[at] += 1e-2
            down[at] -= 1e-2
            pair = ((up, state), (down, state)) if which == 0 else ((table, up), (table, down))
            difference = (loss(*pair[0]) - loss(*pair[1])) / 2e-2
            assert grad[at] == pytest.approx(difference, rel=0.05, abs=0.02)


def test_words_of_a_text(spark):
    from nichelens.llm.common import word_list

    texts = ["Éa B-c_d", "", None, "...", "  x ", "Kelvin İx", "a b\x7fc"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.n for r in rows.select("i", F.size(word_list(F.col("text"))).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [len((t or "").encode().translate(FOLD).split()) for t in texts]


def test_lm_model_grows_with_the_corpus(spark):
    """What is learned of a text stays when very many unrelated contexts are learned beside it."""
    r = random.Random(11)
    mine = [(1, "the model keeps what it has learned " + prose(77, 150)), (8, prose(78, 100))]
    noise = [(100 + k, "".join(chr(r.randrange(33, 127)) for _ in range(20_000))) for k in range(150)]

    def score(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return {x.doc_id: x.score for x in lm.scores(docs, F.lit(False)).where("doc_id < 100").collect()}

    alone, beside = score(mine), score(mine + noise)
    assert set(alone) == set(beside) == {1, 8}
    assert beside[1] > 1.25 * alone[1] and beside[8] > 1.25 * alone[8]


def test_lm_counts_are_exact():
    texts = [prose(k, 30).encode() for k in range(4)] + [b"", "é".encode()]
    flat, _, place = lm._joined(texts)
    for keys in lm._keys(flat, place):
        known, counts = lm._summed(keys, np.ones(len(keys), np.int64))
        odds, at = lm.path_odds(known, counts, known), 0
        for key in known.tolist():
            inside = [(k & 255, n) for k, n in zip(known.tolist(), counts.tolist(), strict=True) if k >> 8 == key >> 8]
            path = range(int(lm._START[key & 255]), int(lm._START[key & 255] + lm._SIZE[key & 255]))
            low, high = 0, 256
            for step in path:
                middle = int(lm._RIGHT[step])
                zeros, ones = (sum(n for x, n in inside if a <= x < b) for a, b in ((low, middle), (middle, high)))
                assert odds[at] == np.clip(np.round(np.log((ones + 0.1) / (zeros + 0.1)) / lm.UNIT), -127, 127)
                low, high = (middle, high) if lm._BIT[step] else (low, middle)
                at += 1
            assert (low, high) == (key & 255, (key & 255) + 1)
        assert at == len(odds)


def test_language_sample_of_copies(spark):
    """A language of few texts in many copies is learned, and copies take no more than one place."""
    few = [(f"few{lang}", f"mucho texto {lang} repetido") for lang in range(6) for _ in range(3000)]
    many = [("many", prose(k, 12)) for k in range(700)] + [("many", "the same text again and again")] * 700
    rows = spark.createDataFrame(few + many, "lang string, text string").withColumn("pick", F.xxhash64("text", "lang"))
    sample, languages = langid.sample_segments(rows)
    assert languages == sorted({f"few{k}" for k in range(6)} | {"many"}) == sorted({name for name, _ in sample})
    per = 2 * langid.TRAIN_DOCS * langid.TRAIN_SEGMENTS
    assert all(sum(name == lang for name, _ in sample) <= (per if lang == "many" else langid.TRAIN_SEGMENTS) for lang in languages)


def test_fingerprints_find_near_documents_anywhere(spark):
    base = prose(21, 900).split()
    edited = [*base[:-1], "other"]
    texts = [" ".join(base), prose(22, 300), prose(23, 300), " ".join(edited), " ".join(base)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.compare_edits(rows).collect()}
    f = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for i, r in got.items():
        assert r.n_near == sum(0 < (v ^ f[i]).bit_count() <= 6 for v in set(f.values()))
    assert len(got) == 5 and got[0].n_near == 1 and got[0].near_class == got[3].near_class == got[4].near_class == min(got[0].fingerprint, got[3].fingerprint)


def test_bpe_with_other_patterns(spark):
    import tiktoken

    from nichelens.llm import bpe
    from nichelens.llm.queries import PATTERN, RANKS

    texts = ["the cat. sat, on?", "a  b\n c", "x" * 300, "ªº ɐb été! don't 12a. a;b", "", "é.é", "ﬀ. a·b."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pattern in (PATTERN, r"[\s\S]{1,3}", r"\S+|\s+"):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Ranks(RANKS).rank, special_tokens={})
        got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, RANKS, pattern).collect()}
        assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
