"""Fingerprints of texts whose terms all vote for the same bits."""

from pyspark.sql import functions as F

from nichelens.llm import simhash


def test_votes_of_a_repeated_term_do_not_overflow(spark):
    texts = {1: "long word " * 9000, 2: "word " * 40_000, 3: "aa bb " * 5000 + "long word " * 12_000}
    rows = spark.createDataFrame(list(texts.items()), "k int, t string")
    got = {r.k: r.fingerprint for r in simhash.fingerprints(rows, ["k"], "t").collect()}

    def weight(term):
        return 1 + sum(len(w) >= simhash.LONG_WORD for w in term)

    weights = {}
    for k, text in texts.items():
        words = text.split()
        for term in zip(words, words[1:], strict=False):
            weights[k, term] = weights.get((k, term), 0) + weight(term)
    terms = sorted({t for _, t in weights})
    hashed = spark.createDataFrame(terms, "a string, b string").select("a", "b", F.xxhash64("a", "b"), F.xxhash64(F.lit(1), "a", "b")).collect()
    hashes = {(a, b): [x & (1 << 64) - 1 for x in h] for a, b, *h in hashed}
    for k in texts:
        mine = {t: w for (i, t), w in weights.items() if i == k}
        want = ""
        for s in range(simhash.WORDS):
            votes = [sum(w for t, w in mine.items() if hashes[t][s] >> bit & 1) for bit in range(64)]
            want += f"{sum(1 << bit for bit, v in enumerate(votes) if 2 * v > sum(mine.values())):016X}".lower()
        assert got[k] == want
