import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from nichelens.functions import entities as e
from nichelens.functions import textkeys as t
from nichelens.functions.html import strip_html


def test_canonicalize_url(values):
    pairs = [
        ("https://WWW.OpenAI.com/News", "https://openai.com/News"),
        ("https://x.com/news?ref=hn&fbclid=x", "https://x.com/news"),
        ("https://x.com:443/news/", "https://x.com/news"),
        ("http://x.com:8080", "http://x.com:8080/"),
        ("openai.com/news", "https://openai.com/news"),
        ("https://x.com/?b=2&a=1&c=&UTM_x=1#f", "https://x.com/?a=1&b=2"),
        ("  ", None),
        (None, None),
        ("see https://a.com/x", "https:///see https://a.com/x"),
        ("http//://b", "https:///http//://b"),
        ("1http://c.com", "https:///1http://c.com"),
        ("//a.com/x://y", "https://a.com/x://y"),
        ("https://[::1]:8443/x", "https://::1:8443/x"),
        ("https://u:p@[FE80::A]/", "https://fe80::a/"),
        ("https://[::1/x", None),
        ("https://a.com:80x/", None),
        ("https://a.com:70000/", None),
        ("https://a.com:0443/", "https://a.com/"),
        ("mailto:x", None),
        ("https://a.com/?q=a~b*c+d%zz&r=%41", "https://a.com/?q=a~b%2Ac+d%25zz&r=A"),
    ]
    assert values([p[0] for p in pairs], t.canonicalize_url) == [p[1] for p in pairs]


def test_strip_tracking_keeps_order_and_blanks(values):
    pairs = [
        ("https://a.b/c?z=1&utm_s=2&a=", "https://a.b/c?z=1&a="),
        ("https://a.b/c?reference=1", "https://a.b/c"),
        ("https://a.b/c#x", "https://a.b/c#x"),
        ("https://a.b/c?q=~*+%zz", "https://a.b/c?q=~%2A+%25zz"),
    ]
    assert values([p[0] for p in pairs], t.strip_tracking) == [p[1] for p in pairs]


def test_audience(values):
    got = values(
        ["https://blog.habr.com/x", "habr.com", "https://nothabr.com", None],
        lambda c: t.audience_can_open(c, ("habr.com",)),
    )
    assert got == [True, True, False, False]


def test_normalize_text_equals_python(values):
    samples = ["Ｈｅｌｌｏ  Wörld", "ﬁne № 5", "ét", "Ünïcode space", "plain  text\n x ", "½ µ", None, ""]
    want = [
        re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s or "").lower()).strip() for s in samples
    ]
    assert values(samples, t.normalize_text) == want


def test_stable_ranges_are_stable():
    inside = re.compile(f"[{t.NFKC_STABLE}]")
    for code in range(0x80, 0x3000):
        char = chr(code)
        if inside.match(char):
            assert unicodedata.normalize("NFKC", char) == char, hex(code)
            # Composition needs a combining second character, which is outside.
            assert unicodedata.combining(char) == 0, hex(code)


def literal_simhash(text):
    words = [w for w in re.findall("[0-9a-zıа-яё]+", text) if len(w) > 1 and w not in t.STOPWORDS]
    votes = [0] * 64
    for w in words:
        h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    value = sum(1 << i for i in range(64) if votes[i] > 0)
    return value - (1 << 64) if value >= 1 << 63 else value, len(words)


def test_simhash_table(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha beta gamma delta the of новый ход".split()) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    got = t.simhash_table(df.select("k", t.tokenize(F.col("x")).alias("w")), "k", "w").collect()
    assert {r["k"]: (r["simhash"], r["token_count"]) for r in got} == {
        i: literal_simhash(x) for i, x in enumerate(texts)
    }


def test_entities(values):
    rules = e.EntityRules()
    vendors = values(["claude by google", "copilot news", "nothing"], lambda c: e.detect_vendor(c, rules))
    assert vendors == ["anthropic", "microsoft", None]
    events = values(["openai released x", "how to write", "plain"], lambda c: e.detect_event_type(c, rules))
    assert events == ["RELEASE", "GUIDE", "OTHER"]
    versions = values(["Claude Haiku 4.5", "v2.37.6 out", "n8n@2.37.7", "year 2024"], e.detect_version)
    assert versions == ["4.5", "2.37.6", "2.37.7", None]
    product = values(
        ["google and gemini for work", "openai introduces codex"],
        lambda c: e.detect_product(c, F.when(c.contains("google"), "google").otherwise("openai"), rules),
    )
    assert product == ["gemini", "introduces"]


def test_year_week_matches_strftime(spark):
    days = spark.sql("SELECT explode(sequence(date'2019-12-25', date'2028-01-10')) AS d")
    got = days.select("d", e.year_week(F.col("d").cast("timestamp")).alias("w")).collect()
    assert all(r["w"] == r["d"].strftime("%Y-%W") for r in got)


def test_strip_html(values):
    got = values(["<p>a&nbsp;&amp;  b</p>", "x &hellip; <b>y</b>", "<br>", "&amp;lt;"], strip_html)
    assert got == ["a & b", "x … y", None, "&lt;"]
