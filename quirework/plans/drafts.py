"""Stated drafts and what the steps of ``functions.drafts`` make of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import drafts as D
from quirework.plans import fixtures as X
from quirework.plans.registry import query
from quirework.session import ship

FILES = frozenset({"img/big.png", "img/small.png"})
LEVELS = {"the mill": 2, "looms": 3}
WRAPS = [("and could stop for", "hours when a belt"), ("wet, cold and", "dark")]
DECISIONS = {"customer-driven": "customer-driven", "op-erators": "operators", "businessvalue": "business-value", "de-fined": "defined"}
STEPS = {
    "style_spans": (D.style_spans, ()),
    "plain_tables": (D.plain_tables, ()),
    "local_url": (D.local_url, ("part/one/topic.html",)),
    "full_images": (D.full_images, (FILES,)),
    "note_markers": (D.note_markers, ()),
    "own_anchors": (D.own_anchors, ("source",)),
    "original_title": (D.original_title, ()),
    "join_dangling": (D.join_dangling, ()),
    "structure": (D.structure, ()),
    "promote_headings": (D.promote_headings, (LEVELS,)),
    "rejoin_wraps": (lambda t: D.rejoin(t, WRAPS, DECISIONS, False)[0], ()),
    "rejoin_breaks": (lambda t: D.rejoin(t, WRAPS, DECISIONS)[0], ()),
    "rejoin_words": (D.rejoin_words, (DECISIONS,)),
}
#: step, draft, what must come of it.
CASES = [
    ("style_spans", '<span class="calibre1">A <span class="calibre2 calibre3">B</span> <span id="x">C</span></span>', 'A B <span id="x">C</span>'),
    ("style_spans", "**GTI Cu**<span class=\"calibre9\">**s**</span>**tomer**", "**GTI Customer**"),
    ("style_spans", '```\n<span class="calibre1">a</span>\n```\n</span>b', '```\n<span class="calibre1">a</span>\n```\n</span>b'),
    ("plain_tables", '<TABLE class="c"><colgroup><col></colgroup><tr id="r1"><td colspan="2" style="x">a</td></tr></TABLE>', '<table><tr id="r1"><td colspan="2">a</td></tr></table>'),
    ("plain_tables", '```\n<table class="c">\n```', '```\n<table class="c">\n```'),
    ("local_url", "../two/a%20b.html#x", "part/two/a b.html#x"),
    ("local_url", "..\\..\\index.htm", "index.htm"),
    ("local_url", "../../../out.html", "../../../out.html"),
    ("local_url", "https://example.org/a", "https://example.org/a"),
    ("local_url", "#here", "#here"),
    ("full_images", '<a href="img/big.png"><img alt="" src="img/small.png"></a>', '<a href="img/big.png"><img alt="" src="img/big.png"></a>'),
    ("full_images", '<a href="img/gone.png"><img src="img/small.png"></a>', '<a href="img/gone.png"><img src="img/small.png"></a>'),
    ("full_images", '<a href="page.html"><img src="img/small.png"></a>', '<a href="page.html"><img src="img/small.png"></a>'),
    ("note_markers", 'Lean<span class="calibre26">12</span> and <span class="calibre26">11</span>个 <span class="b">3</span>', 'Lean^12^ and <span class="calibre26">11</span>个 <span class="b">3</span>'),
    ("note_markers", 'said\\[x] <sup>[<a href="#n4">4</a>]</sup> and <sup><a id="r">*12*</a></sup>\n```\n<sup><a>1</a></sup>\n```', 'said\\[x] ^4^ and ^12^\n```\n<sup><a>1</a></sup>\n```'),
    ("own_anchors", '<div><span id="f1"></span>See <a href="#f1">it</a>.<span id="f1"></span></div>', '<span id="source-f1"></span>See <a href="#source-f1">it</a>.'),
    ("original_title", "Smith, Ann\n\nThe Working of Mills / by Ann Smith", "The Working of Mills"),
    ("original_title", "no title / here", ""),
    ("join_dangling", "他没有来，因为\n\n下雨了。", "他没有来，因为下雨了。"),
    ("join_dangling", "他没有来，因为\n\n# 题", "他没有来，因为\n\n# 题"),
    ("structure", "**1**\n\n**The Mill**\n\n## A motto\n\n**1.1 Looms**\n\n**(a) Belts**\n\ntext", "# 1 The Mill\n\n*A motto*\n\n## 1.1 Looms\n\n### (a) Belts\n\ntext"),
    ("structure", "前言\n\n## iv\n\n## 第一部分\n\n**起点**\n\n### 第 2 章内容提要", "# 前言\n\n# 第一部分 起点\n\n### 第 2 章内容提要"),
    ("promote_headings", "Chapter 3\n\nx\n\n# Chapter 4\n\nThe *Mill*\n\n```\n\nLooms\n\n```\n\nLooms", "Chapter 3\n\nx\n\n# Chapter 4 The Mill\n\n```\n\nLooms\n\n```\n\n### Looms"),
    ("rejoin_wraps", "It and could stop for\n\nhours when a belt broke.\n\n# It and could stop for\n\nhours when a belt broke.", "It and could stop for hours when a belt broke.\n\n# It and could stop for\n\nhours when a belt broke."),
    ("rejoin_wraps", "wet, cold and\n\n![](a.png)\n\ndark", "wet, cold and\n\n![](a.png)\n\ndark"),
    ("rejoin_breaks", "wet, cold and\n\n![](a.png)\n\nFigure 3 A mill\n\ndark it was", "wet, cold and dark it was\n\n![](a.png)\n\nFigure 3 A mill"),
    ("rejoin_words", "op- erators are customer-\ndriven by businessvalue, de-* *fined", "operators are customer-\ndriven by business-value, defined"),
]
WANTED = X.values("w", [(i, step, want) for i, (step, _, want) in enumerate(CASES)], "pos int, step string, draft string")


@query("drafts_cases", f"WITH {WANTED} SELECT pos, step, draft FROM w")
def drafts_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step on drafts that show what it does and what it leaves alone."""
    ship(spark)
    rows = spark.createDataFrame([(i, step, draft) for i, (step, draft, _) in enumerate(CASES)], "pos int, step string, draft string")
    parts = [rows.where(F.col("step") == name).select("pos", "step", D.column(fn, *parameters)(F.col("draft")).alias("draft")) for name, (fn, parameters) in STEPS.items()]
    return reduce(DataFrame.unionByName, parts)
