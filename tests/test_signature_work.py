"""Signatures count votes where a row is: no row is made for a token, and a text is folded once."""

import hashlib

from nichelens.functions import textkeys as t
from nichelens.plans import document_queries as dq
from nichelens.plans import domain as d

SF = "/root/testdata/sf0.001"


def test_tokens_are_not_exploded_and_texts_folded_once(spark):
    plan = dq.clu.build_signatures(d.items_without_pages(spark, SF), dq.RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1
    # Title, summary and excerpt, and nothing of them a second time.
    assert plan.count("lower(coalesce(") == 3


def test_votes_of_odd_rows(spark, monkeypatch):
    rows = [(1, ["a", "bb", "a"]), (1, ["c"]), (2, None), (3, []), (4, [None, "x"]), (5, [None]), (None, ["q", "ж"])]
    got = {r["k"]: r for r in t.simhash_table(spark.createDataFrame(rows, "k int, w array<string>"), "k", "w").collect()}

    def expected(tokens):
        hashes = [int.from_bytes(hashlib.md5(x.encode()).digest()[:8]) for x in tokens]
        bits = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
        return (bits - (1 << 64) if bits >> 63 else bits, len(tokens))

    wanted = {1: ["a", "bb", "a", "c"], 2: [], 3: [], 4: ["x"], 5: [], None: ["q", "ж"]}
    assert {k: (r["simhash"], r["token_count"]) for k, r in got.items()} == {k: expected(v) for k, v in wanted.items()}


def test_votes_do_not_depend_on_how_a_batch_is_cut(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([["a", "b"], [], ["a"] * 5])], names=["k", "w"])
    whole = pa.Table.from_batches(t._votes([batch]))
    monkeypatch.setattr(t, "VOTE_TOKENS", 2)
    assert pa.Table.from_batches(t._votes([batch])).equals(whole)
