"""Checks of translations, drafts, furniture and plans of what to do again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.functions import drafts, hashing
from quirework.operators import furniture, planning, quality, reports
from quirework.plans import drafts as draft_cases
from quirework.plans import planning as planning_cases
from quirework.plans import quality as quality_cases
from quirework.plans import registry


@pytest.mark.parametrize("case", [c for c in quality_cases.CASES if not c[0].startswith("year moved")], ids=lambda c: c[0])
def test_each_fault_gives_its_finding(case):
    _, _, source, target, notes, want = case
    found, _, _ = quality.examine(source, target, notes)
    assert {f[:2] for f in found} == want


def test_checks_of_empty_and_null_pairs(spark):
    rows = [("b", "1", 1, None, None, "x"), ("b", "2", 2, "", "added", "x"), ("b", "3", 3, "lost", None, "x")]
    got = quality.checks(spark.createDataFrame(rows, "book_id string, id string, ord int, source_text string, target_text string, found string"), ["book_id"], "ord", ["id"]).collect()
    assert {(r.id, r.check_id, r.status) for r in got} == {("2", "content.block_coverage", "warn"), ("3", "unit.output", "fail")}


def test_stated_cases_in_spark(spark):
    got = {(r["case"], r.ord, r.check_id, r.status) for r in registry.QUERIES["quality_cases"](spark, "").collect()}
    assert got == {(c, o, *f) for c, o, _, _, _, found in quality_cases.CASES for f in found}


@pytest.mark.parametrize("step,draft,want", draft_cases.CASES)
def test_drafts(step, draft, want):
    fn, parameters = draft_cases.STEPS[step]
    assert fn(draft, *parameters) == want


@pytest.mark.parametrize("fn", [drafts.style_spans, drafts.plain_tables, drafts.note_markers, drafts.join_dangling, drafts.structure, drafts.original_title])
def test_draft_steps_of_odd_texts(fn):
    assert fn("") == ""
    assert isinstance(fn("<span class='calibre1'>" * 2000 + "x\n\n" * 2000), str)


def test_draft_step_as_a_column(spark):
    rows = spark.createDataFrame([("<td class='x'>a</td>",), (None,), ("",)], "t string")
    assert [r.t for r in rows.select(drafts.column(drafts.plain_tables)(F.col("t")).alias("t")).collect()] == ["<td>a</td>", None, ""]


def test_rejoined_words_are_counted_once():
    text, n = drafts.rejoin("a wet and\n\ndark night\n\na wet and\n\nother", [("wet and", "dark")])
    assert text == "a wet and dark night\n\na wet and\n\nother" and n == 1
    assert drafts.join_halves("轴承", "预紧") == "轴承预紧" and drafts.join_halves("de-*", "*fined") == "defined"


def test_plan_of_each_unit(spark):
    got = {r.unit_id: (r.queue, r.reasons, r.edit) for r in registry.QUERIES["planning_cases"](spark, "").collect()}
    assert got == {c[0][0]: c[1] for c in planning_cases.CASES}


def test_a_change_next_door_is_a_change(spark):
    units = spark.createDataFrame([("b", f"u{i}", i, "n", [f"s{i}"], "h") for i in range(3)], "book_id string, unit_id string, ord int, book_node_id string, segment_ids array<string>, source_hash string")
    segments = spark.createDataFrame([("b", f"s{i}", f"A wheel {i}." if i else "Text.") for i in range(3)], "book_id string, id string, text string")
    nodes = spark.createDataFrame([("b", "n", "chapter", 1, "T", ["s0"], [], None)], "book_id string, id string, kind string, ord int, title string, segment_ids array<string>, children array<string>, status string")
    entries = lambda target: spark.createDataFrame([("g", "wheel", target, None, "confirmed", [], None, None)], "id string, source string, target string, aliases array<string>, status string, scopes array<string>, category string, domain string")
    capsules = lambda sha: spark.createDataFrame([("b", "u0", sha)], "book_id string, unit_id string, sha string")
    of = lambda g, c: {r.unit_id: r.hashes for r in planning.dependencies(units, segments, nodes, entries(g), capsules(c), {"config": "c"}).collect()}
    before, after = of("Rad", "k1"), of("Reifen", "k2")
    differ = {u: {k for k in before[u] if before[u][k] != after[u][k]} for u in before}
    assert differ == {"u0": set(), "u1": {"glossary_selection", "incoming_capsule"}, "u2": {"glossary_selection"}}
    assert before["u0"]["incoming_capsule"] == "root" and before["u2"]["incoming_capsule"] == "missing" and before["u0"]["config"] == "c"


def test_unproven_pages_against_counters(spark):
    rows = [("a", 1, "one two"), ("a", 1, "x"), ("a", 2, "three"), ("b", 1, "四 五")]
    left = [("a", 1, "one"), ("a", 2, "thre"), ("b", 1, "四")]
    removed = [("a", 1, "twox"), ("a", 2, "f"), ("b", 1, "五")]
    frames = [spark.createDataFrame(x, "book_id string, page int, text string") for x in (rows, left, removed)]
    bag = lambda x, p: Counter(c for r in x if r[:2] == p for c in r[2] if not c.isspace())
    want = {p for p in {r[:2] for r in rows} if bag(rows, p) != bag(left, p) + bag(removed, p)}
    assert {(r.book_id, r.page, r.missing, r.unexpected) for r in furniture.unproven(*frames).collect()} == {("a", 2, "e", "f")} and want == {("a", 2)}


def test_settings_that_make_no_difference():
    base = {"source": {"language": "en", "path": "x"}, "target": {"language": "zh"}, "layout": {"font": "a"}}
    of = lambda s: hashing.settings_hash(s, hashing.TRANSLATION_SETTINGS, {"custom_instructions": []})
    assert of(base) == of(hashing.deep_merge(base, {"layout": {"font": "b"}, "source": {"path": "y"}, "custom_instructions": []}))
    assert of(base) != of(hashing.deep_merge(base, {"target": {"language": "de"}}))
    assert hashing.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": [3]}, "d": None}) == {"a": {"b": [3], "c": 2}, "d": None}


def test_parts_of_maps(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "b": "2"}, {"a": "1"}), (2, {"a": "1"}, {"a": "2"}), (3, {"a": "1"}, {}), (4, {}, {"a": "1"})], "i int, whole map<string,string>, part map<string,string>")
    assert {r.i for r in rows.where(reports.contains_all(F.col("whole"), F.col("part"))).collect()} == {1, 3}
