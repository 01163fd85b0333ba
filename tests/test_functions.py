import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.functions import geometry, hashing, markdown, numbers
from quirework.functions import text as T


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\nb", ["a", "", "b"]), ("\n", [""])])
def test_lines(spark, text, want):
    assert one(spark, T.lines(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,weight", [("two words", 2), ("don't", 1), ("轴承预紧", 2.4), ("mixed 轴承 text", 3.2), ("1998 !", 0), ("", 0)])
def test_prose_weight(spark, text, weight):
    assert abs(one(spark, T.prose_weight(F.col("t")), t=text) - weight) < 1e-9


@pytest.mark.parametrize(
    "text,want",
    [("见 https://example.org/guide，下一句", ["https://example.org/guide"]), ("(https://example.org/a)", ["https://example.org/a"]), ("https://example.org/Function_(mathematics).", ["https://example.org/Function_(mathematics)"]), ("none", [])],
)
def test_urls(spark, text, want):
    assert one(spark, T.urls(F.col("t")), t=text) == want


NUMBERS = [
    ("a shortfall of 10 million workers", "将短缺 1,000 万名工人"), ("revenue of $100,000", "收入 10 万美元"), ("since the 1990s", "自 20 世纪 90 年代以来"),
    ("32 percent", "32%"), ("EXHIBIT 6.7 A Process View", "图表 6.7 流程视图"), ("1.1 million", "110万"), ("2.5 billion", "25 亿"), ("9 chapters, 8.5", "第9章 图8.5"), ("a 32 per-\ncent rise", "32%"), ("in 1998", "一九九八年"), ("in 1998", "１９９８年"), ("the fifth", "第 5"),
]


@pytest.mark.parametrize("a,b", NUMBERS)
def test_numbers_by_value(a, b):
    assert sorted(numbers.canonical_tokens(a)) == sorted(numbers.canonical_tokens(b))


@pytest.mark.parametrize("a,b", [("32 percentage points", "32%"), ("in 1989", "in 1998"), ("a 230V supply", "230 伏电源"), ("it draws 10 A.", "10 安"), ("5 W", "5 V")])
def test_numbers_that_differ(a, b):
    assert sorted(numbers.canonical_tokens(a)) != sorted(numbers.canonical_tokens(b))


def test_spelled_and_roman(spark):
    assert {"twenty-one", "twenty one", "二十一"} == set(numbers.SPELLINGS[21]) and "first" in numbers.SPELLINGS[1] and "十" in numbers.SPELLINGS[10] and "两" in numbers.SPELLINGS[2]
    assert [numbers.roman(n) for n in (1, 4, 9, 14, 40, 99, 199)] == ["i", "iv", "ix", "xiv", "xl", "xcix", "cxcix"]
    assert numbers.spelled_table(spark).select("value").distinct().count() == 100
    assert numbers.folio_table(spark).count() == 199


def test_markup_only_and_plain(spark):
    assert one(spark, T.is_markup_only(F.col("t")), t="![a b](c.png)\n<hr/> 12")
    assert not one(spark, T.is_markup_only(F.col("t")), t="<b>x</b>")
    assert one(spark, T.plain(F.col("t")), t="## The *old* <span class='x'>mill</span>  ") == "The old mill"
    assert one(spark, T.display_width(F.col("t")), t="轴a\u0301") == 3
    assert one(spark, T.caption_key(F.col("t")), t="2.1–3b") == "2.1-3B"


FENCED = "a\n```\n# not a heading\n\n```\n# heading"


def test_outside_fences(spark):
    assert one(spark, markdown.outside_fences(F.col("t"), lambda x: F.upper(x)), t=FENCED) == "A\n```\n# not a heading\n\n```\n# HEADING"
    assert one(spark, markdown.drop_wrappers(F.col("t")), t='<div class="x">\na\n</div>\n```\n<div>\n```') == "a\n```\n<div>\n```"


def test_html_rewrites(spark):
    assert one(spark, markdown.html_headings(F.col("t")), t="<h2 id='a'> T </h2>x<H1>U</H1>") == "## Tx# U"
    assert one(spark, markdown.superscripts(F.col("t")), t="a<sup>[12]</sup> b<sup>th</sup>") == "a^12^ b<sup>th</sup>"
    text = '<a id="x"></a> [one](#x) [two](#y.z) [three](#y.z) [four](http://a/#y.z)'
    assert one(spark, markdown.flatten_dead_links(F.col("t")), t=text) == '<a id="x"></a> [one](#x) two three [four](http://a/#y.z)'


def test_pipe_tables(spark):
    table = "| a | b |\n|---|---:|\n| 1 | x\\|y |\n"
    assert one(spark, markdown.table_rows(F.col("t")), t="| a | b |\n|---|---:|\n| 1 | 2 |") == [["a", "b"], ["1", "2"]]
    assert one(spark, markdown.pipe_tables(F.col("t")), t=table + "\n---\n" + table) == 2
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1"), F.lit("2")))
    assert one(spark, markdown.pipe_table(rows, F.lit(True))) == "| a | b\\|c |\n|---|---|\n| 1 | 2 |"
    assert one(spark, markdown.pipe_table(rows, F.lit(False))).split("\n")[0] == "|  |  |"


def test_html_tables(spark):
    html = "x<table><tr><th>a<th>b</tr><tr><td colspan=2>c<table><tr><td>inner</td></tr></table></td></tr></table>y"
    out = spark.createDataFrame([(html,), (None,), ("none",)], "t string").select(markdown.html_tables_as_markdown("t").alias("x")).collect()
    assert out[0].x == "x| a | b |\n|--------|-----|\n| cinner |  |y" and out[1].x is None and out[2].x == "none"
    assert markdown.outer_tables("<table><table></table></table><table>") == [(0, 30)]
    assert markdown.html_table_grids("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == [[["a", "b"], ["", "c"]]]
    wide = [["key", *("column %d with a long head" % i for i in range(9))], ["k", *"123456789"]]
    groups = markdown.split_wide(wide)
    assert len(groups) == 3 and all(g[0][0] == "key" and len(g[0]) <= 5 for g in groups)
    assert [c for g in groups for c in g[1][1:]] == list("123456789")


def test_captions(spark):
    text = "See Figure 3–4a and figure 3-4A, Table 2; 图 5 and the map 7. Configure 9"
    assert sorted(one(spark, markdown.caption_labels(F.col("t")), t=text)) == ["figure 3-4A", "figure 5", "figure 7", "table 2"]


def test_hashes(spark):
    a = one(spark, hashing.fields_hash(F.lit("x"), F.lit(None).cast("string")))
    assert a != one(spark, hashing.fields_hash(F.lit("x"), F.lit("")))
    rows = spark.createDataFrame([('{"b":1,"a":{"d":2,"c":null}}',), ('{ "a" : {"c":null,"d":2}, "b":1 }',), ("{",), (None,)], "t string")
    got = [r.x for r in rows.select(hashing.canonical_json_hash("t").alias("x")).collect()]
    assert got[0] == got[1] and got[2] is None and got[3] is None
    assert one(spark, hashing.text_hash(F.col("t")), t=" x \n") == one(spark, hashing.text_hash(F.lit("x")))


def test_geometry(spark):
    v = [F.lit(float(x)) for x in (0, 10, 5, 20)]
    assert one(spark, geometry.vertical_overlap(*v)) == 0.5
    assert one(spark, geometry.coverage(F.lit(3.0), F.lit(2.0))) == 1.0
    box = spark.range(1).select(*geometry.normal_box(*[F.lit(float(x)) for x in (-5, 0, 50, 900, 100, 800)])).first()
    assert tuple(box) == (0.0, 0.0, 0.5, 1.0)


def test_tokens_against_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1 _-.é字Ж\n") for _ in range(40)) for _ in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokens(F.col("t")).alias("x")).collect()
    assert all(r.x == [w.lower() for w in re.findall(r"[^\W_]{2,}", r.t)] for r in rows)
