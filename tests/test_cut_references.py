"""Character references that a cut leaves open."""

from nichelens.functions.html import strip_html
from nichelens.sources import payloads


def test_cut_references_stay(values):
    texts = ["a &am", "a &amp", "b &amp; &copy; c &copy d &", "&notit; &#65; &#65 &amp;amp"]
    assert values(texts, lambda c: strip_html(c, closed=True)) == ["a &am", "a &amp", "b & © c &copy d &", "&notit; A &#65 &amp"]
    assert values(texts[1:2], strip_html) == ["a &"]


def test_feed_bodies_keep_cut_references(spark):
    rss = "<rss><channel><item><title>A</title><link>https://a.b/1</link><description><![CDATA[x &amp]]></description></item></channel></rss>"
    atom = '<feed><entry><title>B</title><link href="https://a.b/2"/><content type="html">y &amp;amp</content></entry></feed>'
    raw = spark.createDataFrame([("s", rss), ("s", atom)], "source_key string, payload string")
    got = payloads.read_feed_xml(raw, closed_references=True).orderBy("url").collect()
    assert [r["summary"] for r in got] == ["x &amp", "y &amp"]
