"""The awkward rows of the small tables."""

import random

NAMES = "ids id row h n_words pos text__ key w node band span lang_pred"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, words=("the", "ther", "ing", "onan", "ed", "la", "que", "éau", "und", "heit")) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n))


def document_rows():
    """(doc_id, text, lang): copies, near copies, shared passages, benchmark words, odd texts."""
    passage, base = prose(1, 70), prose(2, 120)
    near = base.split()
    near[60] = "other"
    item = prose(3, 14)
    rows = [
        (1, base, "en"), (2, base, "en"), (3, " ".join(near), "en"), (4, prose(4, 40) + " " + passage + " " + prose(5, 30), "fr"),
        (5, prose(6, 20) + " " + passage, "fr"), (6, passage + "\n" + prose(7, 9) + "\n\n" + passage, "fr"),
        (7, "MIT License, and the Apache License.\nGNU GENERAL PUBLIC LICENSE version 3, CC BY-NC 4.0", "en"),
        (8, "see " + item.translate({c: c - 32 for c in range(97, 123)}) + " end", "en"), (9, None, "en"), (10, "", None), (11, " \n\t ", "de"), (12, "!!! 123 ...", None),
        (13, "é", "fr"), (14, "日本語" * 40, None), (15, "x" * 700, "en"), (16, "ab" * 300 + "é", "de"), (17, prose(8, 3000), "de"),
        (18, "\U0001f600 a\x1cb\u00a0c  d \u2003 e", "es"), (19, prose(9, 4), "es"), (20, prose(9, 4), "es"), (21, "Kelvin mit license", "en"),
        (22, "xé" * 49, "es"), (23, "é" + "xé" * 49, "es"), (None, base, "en"), (None, "", None), (24, prose(10, 60), "de"), (24, prose(10, 60), "de"),
    ]
    return [(i, t, g, "src", None if t is None else len(t)) for i, t, g in rows]


def benchmark_rows():
    return [("b1", prose(3, 14)), ("b2", "Kelvin mit"), ("b2", "Kelvin mit"), ("b3", None), (None, "x" * 700), ("b4", " ,. "), ("b10", prose(3, 14))]


def page_rows():
    link = '<a class="c" href="{}">x</a>'
    return [
        (1, "http://a.example.com/en/1", link.format("http://B.org/x") + link.format("/local")), (2, "HTTP://www.Example.com/en/2?q#f", None),
        (3, "http://b.org/en", link.format("//c.net/es/1")), (4, "https://c.net/es/1", ""), (5, "https://c.net/es/2", ""), (6, "https://c.net/de/2", ""),
        (7, "nohost", "x"), (8, None, None), (9, "http://", ""), (10, "http://example.com", ""), (11, "http://xexample.com/en/", ""), (11, "http://xexample.com/en/", ""),
        (None, "http://d.org?x", link.format("https://c.net/es/1")), (12, "http://net/fr/", ""), (13, "x://y.COM/A?b://c", link.format("https://b.org")),
    ]
