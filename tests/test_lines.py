import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import lines as L
from quirework.operators import structure


def one(spark, expression, lines):
    return spark.createDataFrame([(lines,)], "x array<string>").select(expression(F.col("x")).alias("y")).first().y


def test_joined(spark):
    assert one(spark, L.joined, ["could stop for ho-", "urs when ", "", "a belt"]) == "could stop for hours when a belt"
    assert one(spark, L.joined, ["Smith-", "Jones"]) == "Smith- Jones" and one(spark, L.joined, []) == ""


def test_recovery_and_contents(spark):
    rows = ["# A", "x", "y", "## Recovered pages", "z"]
    assert one(spark, lambda c: L.before_recovery(c, ["Recovered pages"]), rows) == rows[:3]
    assert one(spark, lambda c: L.before_recovery(c, ["Recovered pages"]), ["## Recovered pages", *"abcd"]) == ["## Recovered pages", *"abcd"]
    book = ["# T", "# Contents", "One 1", "Two 2", "# One", "text"]
    assert one(spark, lambda c: L.without_contents(c, "^# Contents$", "^# "), book) == ["# T", "[TOC]", "# One", "text"]
    assert one(spark, lambda c: L.without_contents(c, "^# None$", "^# "), book) == book


def test_titles_and_marks(spark):
    assert one(spark, L.first_title, ["text", "**Bold title**", "# Later"]) == "Bold title"
    assert one(spark, L.first_title, ["text"]) is None
    assert one(spark, lambda c: L.is_bold(F.get(c, F.lit(0))), ["**x y**"]) and not one(spark, lambda c: L.is_bold(F.get(c, F.lit(0))), ["**x** y"])
    assert one(spark, lambda c: L.is_running_folio(F.get(c, F.lit(0)), F.lit(12)), ["12 A History of Work"])
    assert not one(spark, lambda c: L.is_running_folio(F.get(c, F.lit(0)), F.lit(12)), ["In all there were 12."])
    assert sorted(["6.10", "6.9", "2-1"], key=lambda k: one(spark, lambda c: L.sort_key(F.get(c, F.lit(0))), [k])) == ["2-1", "6.9", "6.10"]


def test_list_context_and_fragments(spark):
    assert one(spark, L.list_context, ["- a", "    b", "c", "    d"]) == ["- a", "b", "c", "    d"]
    assert one(spark, L.without_fragments, ["A sentence.", "label", "x y"]) == ["A sentence."] and one(spark, L.without_fragments, ["a", "b"]) == []


@pytest.mark.parametrize("seed", range(6))
def test_cuts_against_the_rule(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word", " ", ". ", "\n", ", ", "。", "；"]) for _ in range(400))
    most = rng.randrange(20, 90)
    at, ends = 0, structure.cut_positions(text, most)
    for end in ends:
        while at and at < len(text) and text[at].isspace():
            at += 1
        assert 0 < end - at <= most
        window = text[at : at + most]
        if end < len(text) and len(text) - at > most:
            ranks = [max((window.rfind(m) + len(m) for m in marks if m in window), default=-1) >= most // 2 for marks in structure.SPLIT_MARKS]
            best = ranks.index(True) if True in ranks else None
            assert best is None and end - at == most or any(text[:end].endswith(m) for m in structure.SPLIT_MARKS[best])
        at = end


def test_pieces(spark):
    rows = [("b", "1", 1, "paragraph", "one. " * 3000), ("b", "2", 2, "code", "x" * 20000), ("b", "3", 3, None, None), ("b", "1", 1, "paragraph", "one. " * 3000)]
    out = structure.split_long(spark.createDataFrame(rows, "book_id string, id string, ord int, kind string, text string")).orderBy("ord", "part").collect()
    assert [(r.id, r.part) for r in out] == [("1", 1), ("1", 2), ("2", 0), ("3", 0)] and out[0].n_chars <= 9000 and out[3].n_chars is None
