"""Link ranks to convergence against plain sums; scores of tables whose rows repeat."""

import math
import re
from collections import Counter

from nichelens.llm import lm, urlfilter
from nichelens.llm.common import LOWER


def plain_ranks(seeds, edges, d=0.85):
    hosts = set(seeds) | {h for e in edges for h in e[:2]}
    good, bad = (max(sum(s[k] for s in seeds.values()), 1) for k in (0, 1))
    out, into = Counter(), Counter()
    for a, b, n in edges:
        out[a] += n
        into[b] += n
    trust, distrust = dict.fromkeys(hosts, 0.0), dict.fromkeys(hosts, 0.0)
    for _ in range(500):
        t, u = ({h: (1 - d) * seeds.get(h, (0, 0))[k] / w for h in hosts} for k, w in ((0, good), (1, bad)))
        for a, b, n in edges:
            t[b] += d * trust[a] * n / out[a]
            u[a] += d * distrust[b] * n / into[b]
        trust, distrust = t, u
    return {h: (trust[h], distrust[h]) for h in hosts}


def test_ranks_converge(spark):
    seeds = {"a": (5, 0), "z": (0, 7), "m": (1, 1), "lone": (2, 3)}
    edges = [("a", "b", 2), ("b", "a", 1), ("b", "c", 3), ("c", "z", 1), ("z", "c", 4), ("m", "z", 2), ("q", "m", 1), ("c", "q", 1)]
    found = urlfilter.propagate(
        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, good long, bad long"),
        spark.createDataFrame(edges, "source string, target string, links long"),
        1e-9,
    )
    want = plain_ranks(seeds, edges)
    got = {r.host: (r.trust, r.distrust) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[h][k], want[h][k], abs_tol=1e-9) for h in want for k in (0, 1))


def test_distrust_reaches_the_end_of_a_chain(spark):
    n, blocked = 20, 2000
    link = '<a href="http://{}.org/">x</a>'
    rows = [(i, f"http://h{i}.org/", link.format(f"h{i + 1}" if i < n - 1 else "bad")) for i in range(n)]
    rows += [(n + i, "http://sink.net/es/", "") for i in range(blocked)]
    rows[n - 1] = (n - 1, f"http://h{n - 1}.org/", '<a href="http://sink.net/">x</a>')
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r.verdict for r in urlfilter.judge(pages).select("host", "verdict").distinct().collect()}
    edges = [(f"h{i}.org", f"h{i + 1}.org", 1) for i in range(n - 1)] + [(f"h{n - 1}.org", "sink.net", 1)]
    ranks = plain_ranks({"sink.net": (0, blocked)}, edges)
    want = {h: "block" if u * blocked >= 0.5 * 0.15 else "allow" for h, (_, u) in ranks.items()}
    assert got == want and want["h0.org"] == "block"


def test_repeated_rows_are_counted_once_each(spark):
    rows = [(i, t) for i, t in enumerate(["a b c", "a b", "", "Kelvin x\ny", "c c c"])] * 2 + [(1, "a b c")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    for parts in (1, 4, 13):
        found = lm.scores(docs.repartition(parts), F.col("doc_id") == 4).collect()
        tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(LOWER)), None]
        counts = Counter(w for i, t in rows if i != 4 for w in tokens(t))
        n, v = sum(counts.values()), len(counts)
        want = Counter(
            (i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows
        )
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
