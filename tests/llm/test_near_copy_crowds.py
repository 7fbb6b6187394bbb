"""Work done for groups of near copies, beside the right result."""

import random

from nichelens import session
from nichelens.llm import neardup


def test_near_copies_are_led_by_their_origin(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        words = list(base)
        for at in r.sample(range(10, 140), 3):
            words[at] = f"x{r.randrange(10**9)}"
        rows.append((i if i < 60 else 1000 + i, " ".join(words)))
    compared = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x.doc_id, x.class_id) for x in found.collect()} == {(i, 0) for i, _ in rows}
    assert sum(compared) <= 3 * len(rows)


def test_used_tables_and_shuffles_go(spark):
    before = set(session._WRITTEN)
    rows = [(i, " ".join(f"{i // 2}w{k}" for k in range(60))) for i in range(20)]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x.doc_id, x.class_id) for x in found.collect()} == {(i, i - i % 2) for i in range(20)}
    left = {p.rsplit("/", 1)[-1].split("-")[0] for p in set(session._WRITTEN) - before}
    assert not left & {"signatures", "buckets", "sets", "mixed", "edges"}


def test_common_passages_are_told_apart_by_what_is_their_own(spark, monkeypatch):
    """Texts of one long passage and a rest of their own each: none is near to another, and no sets are compared."""
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(i, passage + " " + " ".join(f"{i}w{k}" for k in range(20))) for i in range(40)]
    rows.append((99, rows[7][1] + " end"))
    compared = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x.doc_id, x.class_id) for x in found.collect()} == {(i, i if i != 99 else 7) for i, _ in rows}
    assert sum(compared) <= 2 * len(rows)


def _classes_by_hand(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts)}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.items())


def test_far_members_of_a_crowd_are_not_paired_with_all_of_it(spark, monkeypatch):
    """Texts that lack some words of one text: cut alike, so that few of their shingles are their own."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(300):
        gone = set(r.sample(range(5, 145), 2 if i % 2 else 5))
        rows.append((i, " ".join(w for k, w in enumerate(base) if k not in gone)))
    rows += [(300, " ".join(base)), (301, rows[4][1] + " end"), (302, rows[8][1].replace("w149", "last"))]
    compared = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x.doc_id, x.class_id) for x in found.collect()} == _classes_by_hand(rows)
    assert sum(compared) < len(rows) ** 2 / 8


def test_differences_from_a_pivot_lose_no_near_pair(spark):
    r = random.Random(11)
    pivot = set(range(40))
    sets = [(0, pivot)]
    for i in range(1, 220):
        s = sorted(pivot if i % 3 else sets[r.randrange(len(sets))][1])
        sets.append((i, set(r.sample(s, len(s) - r.randrange(0, 12))) | set(r.sample(range(40, 60), r.randrange(0, 7)))))
    table = spark.createDataFrame([(i, sorted(s)) for i, s in sets], "node long, elements array<long>")
    apart = neardup._differences(spark.createDataFrame([(i, 0, 0) for i, _ in sets], "node long, pivot long, own long"), table, 0.8)
    near = {x.node for x in apart.where("near").collect()}
    like = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    assert near == {i for i, s in sets if like(s, pivot)}
    root = {i: 0 if i in near else i for i, _ in sets}
    rows = apart.join(spark.createDataFrame(list(root.items()), "node long, root long"), "node")
    met = {(min(x.a, x.b), max(x.a, x.b)) for x in neardup._by_differences(rows, 0.8).collect()}
    wanted = {(i, j) for i, s in sets for j, t in sets if i < j and root[i] != root[j] and like(s, t)}
    assert wanted and wanted <= met
    assert len(met) < len(sets) ** 2 / 8


def test_other_rows_of_an_id_do_not_hide_a_near_copy(spark):
    """Two rows of one id: what is in one of them only says nothing of the other."""
    text = [" ".join(f"{k}{c}" for k in range(60)) for c in "ab"]
    rows = [(5, text[0]), (5, text[1]), (9, text[1] + " end")]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x.doc_id, x.class_id) for x in found.collect()} == {(5, 5), (9, 5)}
