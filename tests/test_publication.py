import random
import time

import pytest
from pyspark.sql import functions as F

from quirework.functions import publication as P


def one(spark, change, text):
    return spark.createDataFrame([(text,)], "t string").select(change(F.col("t")).alias("x")).first().x


CASES = [
    (P.images, '<img alt="A" src="a.png"/> <img src=\'b.png\'>', "![A](a.png) ![](b.png)"),
    (P.images, "[![a](x.png)](y.html)", "![a](x.png)"),
    (P.lift_images, "# Head ![a](b.png) more\ntext", "# Head more\n\n![a](b.png)\ntext"),
    (P.lift_images, "```\n# x ![a](b)\n```", "```\n# x ![a](b)\n```"),
    (P.flatten_page_links, "[a](p2.xhtml#x) [b](http://e.org/x.html) [c](#d) ![d](e.html)", "a [b](http://e.org/x.html) [c](#d) ![d](e.html)"),
    (P.slashes, '<img src="a\\b\\c.png"> \\emph', '<img src="a/b/c.png"> \\emph'),
    (P.known_roles, '<a href="#x" role="doc-backlink">a</a><a role="chapterjump" href="y">b</a><p role="odd">', '<a href="#x" role="doc-backlink">a</a><a href="y">b</a><p role="odd">'),
    (P.bind_captions, '<p><img src="a"/></p>\n<p>Figure 1 A mill</p><p>Text</p>', '<figure><img src="a"/><figcaption>Figure 1 A mill</figcaption></figure><p>Text</p>'),
    (P.bind_captions, '<p><img src="a"/></p><p>' + "Figure 1 " + "x" * 90 + "</p>", '<p><img src="a"/></p><p>' + "Figure 1 " + "x" * 90 + "</p>"),
    (P.split_captions, "Prose ends. **Figure 2 A mill**", "Prose ends.\n\n**Figure 2 A mill**"),
    (P.residue, "a<!-- x -->b  \n• item\nbook.qxd 1/2/03 4:05 PM Page 7\nend\\", "ab\n- item\n\nend"),
    (P.residue, "```\n• <!-- x -->\n```", "```\n• <!-- x -->\n```"),
    (P.clean, '<div>\n<h2>T</h2>\n</div>\n\n\n\nx<sup>3</sup> [a](q.html)', "## T\n\nx^3^ a"),
    (P.clean, "", ""),
]


@pytest.mark.parametrize("change,text,want", CASES)
def test_steps(spark, change, text, want):
    assert one(spark, change, text) == want


def test_a_text_is_worked_out_once(spark):
    plan = spark.createDataFrame([("",)], "source string").select(P.clean(F.col("source")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("source#") == 2  # where it is read and where it is cleaned


LONG = [
    ("a." * 100_000 + "  \nend", "a." * 100_000 + "\nend"),
    (" " * 100_000 + "x\\", " " * 100_000 + "x"),
    ("```\n" + "• x\n" * 20_000 + "```\n• x", "```\n" + "• x\n" * 20_000 + "```\n- x"),
    ("• x\n" * 20_000 + "~~~\n```\n• x", "- x\n" * 20_000 + "~~~\n```\n• x"),
]


def test_long_words_blanks_and_fences(spark):
    start = time.monotonic()
    for text, want in LONG:
        assert one(spark, P.clean, text) == want
    assert time.monotonic() - start < 30


STAMPS = [
    ("a.qxd 1/2/03 4:05 PMb.indd 1/2/03 4:05 AM c", " c"),
    ("x-y.z.qxd 1/2/03 4:05 PM Page 7 w", " w"),
    ("caf\u00e9a.qxd 1/2/03 4:05 PM", "caf\u00e9"),
    (".qxd 1/2/03 4:05 PM", ".qxd 1/2/03 4:05 PM"),
]


@pytest.mark.parametrize("text,want", STAMPS)
def test_stamps(spark, text, want):
    assert one(spark, P.residue, text) == want


def test_superscripts():
    text = "The mill1 stood in 2005 by the mill2 and mill1."
    assert P.mark_superscripts(text, [("mill", "1"), ("mill", "2"), ("gone", "3")]) == ("The mill^1^ stood in 2005 by the mill^2^ and mill1.", ["gone3"])


def test_tokens():
    assert P.restore_tokens("a @@t1@@ b @@x@@", {"t1": "| c |", "t2": "lost"}) == ("a | c | b @@x@@", ["t2"])


def test_column_widths():
    rng = random.Random(9)
    assert P.column_widths([], 100, 10) == []
    for _ in range(200):
        n = rng.randrange(1, 9)
        cells = [[rng.randrange(0, 200) for _ in range(n)] for _ in range(3)]
        total = rng.randrange(100, 10000)
        widths = P.column_widths(cells, total, 68)
        assert sum(widths) == total and min(widths) >= min(68, total // n) - 1
