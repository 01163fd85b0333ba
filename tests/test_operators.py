import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.operators import conservation, glossary, layout, ledger, structure
from quirework.plans import registry
from quirework.streaming import ledger as stream

SEGMENTS = "book_id string, id string, ord int, kind string, text string, heading_level int, title string, ingested_at string"


def segments(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None)[:8] for r in rows], SEGMENTS)


def test_blocks_keep_fences_whole(spark):
    text = "# T\r\n\r\na\nb\n\n```py\nx\n\ny\n```\nafter\n\n| a | b |\n|---|---|\n\n- i\n\n![p](q.png)\n\n<table>\n<tr></tr></table>\n\n  \n"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n \n")], "doc_id long, text string")
    rows = structure.blocks(df).orderBy("block_no").collect()
    assert [r.kind for r in rows] == ["heading", "paragraph", "code", "paragraph", "table", "list", "image", "table"]
    assert [r.block_no for r in rows] == list(range(1, 9)) and rows[0].title == "T" and rows[2].text == "```py\nx\n\ny\n```"


def test_running_max_over_bucket_borders(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.choice([None, i])) for i in range(0, 300, 2)] + [("b", 7, None), ("b", 9, 9)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    for strict in (False, True):
        got = {(r.g, r.o): r.m for r in structure.running_max(df, ["g"], "o", {"m": F.col("v")}, strict, bucket=16).collect()}
        for g, o, _ in rows:
            seen = [v for h, p, v in rows if h == g and v is not None and (p < o or p == o and not strict)]
            assert got[g, o] == max(seen, default=None)


def test_running_rank(spark):
    rng = random.Random(7)
    rows = [("a", rng.randrange(400), f"t{i}") for i in range(150)] + [("b", 5, "x")]
    got = {(r.g, r.t): r.p for r in structure.running_rank(spark.createDataFrame(rows, "g string, o int, t string"), ["g"], "o", ["t"], "p", bucket=32).collect()}
    for g in "ab":
        own = sorted((o, t) for h, o, t in rows if h == g)
        assert [got[g, t] for _, t in own] == list(range(len(own)))


def test_units_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("a", f"s{i}", i, rng.choice(["heading", *["paragraph"] * 5]), "x" * rng.randrange(3000)) for i in range(1, 120)]
    got = [tuple(r) for r in structure.pack_units(segments(spark, rows + rows[:5])).collect()]
    want, node, used, first, n, no = [], None, 0, None, 0, 0
    for _, _, o, kind, text in [*rows, ("a", "", 999, "end", "")]:
        size, fresh = len(text) + 2, kind in ("heading", "end")
        if n and (fresh or used + size > 6000):
            want.append(("a", node, no, first, last, n, used))
            used, n, first = 0, 0, None
            no = 0 if fresh else no
        if kind == "heading":
            node = o
        no, used, n, first, last = (no + 1 if n == 0 else no), used + size, n + 1, o if first is None else first, o
    key = lambda t: (t[1] or 0, t[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_segments(spark):
    empty = segments(spark, [])
    assert structure.pack_units(empty).count() == structure.assign_nodes(empty).count() == structure.heading_parents(empty).count() == 0


def test_identifiers(spark):
    df = spark.createDataFrame([("b", 1, "The Mill"), ("b", 2, "The mill!"), ("b", 3, "12 Angry"), ("b", 4, "№")], "g string, o int, title string")
    assert [r.identifier for r in structure.with_identifiers(df, "g", "o").orderBy("o").collect()] == ["the-mill", "the-mill-1", "angry", "section"]


def test_bag_difference_is_counter_subtraction(spark):
    rng = random.Random(4)
    a, b = ([(rng.randrange(3), rng.choice("xyz")) for _ in range(40)] for _ in range(2))
    left, right = (spark.createDataFrame(x, "k int, i string") for x in (a, b))
    got = {(r.k, r.i, r.side): r.n for r in conservation.bag_difference(left, right, ["k"], "i").collect()}
    want = {(*k, "source"): n for k, n in (Counter(a) - Counter(b)).items()} | {(*k, "target"): n for k, n in (Counter(b) - Counter(a)).items()}
    assert got == want


GLOSSARY = "id string, source string, target string, aliases array<string>, status string"


def test_surface_patterns(spark):
    entries = [("nn", "neural network", "神经网络", None, "confirmed"), ("st", "strategy", None, ["plan"], None), ("zh", "轴承", None, [], None), ("e", "", None, None, None)]
    texts = [("1", "Neural networks learn; strategies and the strategy's PLANS."), ("2", "A networking neural layer"), ("3", "轴承预紧 planned"), ("4", None)]
    got = {(r.k, r.id): r.n for r in glossary.matches(spark.createDataFrame(texts, "k string, text string"), spark.createDataFrame(entries, GLOSSARY), ["k"]).collect()}
    assert got == {("1", "nn"): 1, ("1", "st"): 3, ("3", "zh"): 1}


def test_glossary_in_blocks(spark, monkeypatch):
    entries = [(f"e{i}", f"term{i}", None, None, None) for i in range(9)]
    texts = spark.createDataFrame([("1", " ".join(f"term{i}" for i in range(9)))], "k string, text string")
    monkeypatch.setattr(glossary, "SURFACES_PER_PASS", 4)
    assert glossary.matches(texts, spark.createDataFrame(entries, GLOSSARY), ["k"]).count() == 9
    assert glossary.matches(texts, spark.createDataFrame([], GLOSSARY), ["k"]).count() == 0


def test_overlay(spark):
    base = spark.createDataFrame([("1", "a", None, ["x"], None), ("2", "b", None, None, None), ("3", "c", None, None, None)], GLOSSARY)
    later = spark.createDataFrame([("9", " X ", None, None, None), ("2", "new", None, None, None)], GLOSSARY)
    assert sorted((r.id, r.source) for r in glossary.overlay(base, later).collect()) == [("2", "new"), ("3", "c"), ("9", " X ")]


def test_clusters_against_brute_force(spark):
    rng = random.Random(5)
    boxes = [(p, *(v := (rng.uniform(0, 300), rng.uniform(0, 300))), v[0] + rng.uniform(1, 40), v[1] + rng.uniform(1, 40)) for p in (1, 2) for _ in range(25)]
    got = Counter((r.page, r.n) for r in layout.clusters(spark.createDataFrame([("a", *b) for b in boxes], "book_id string, page int, x0 double, y0 double, x1 double, y1 double"), 10.0).collect())
    want = Counter()
    for p in (1, 2):
        rest = [b[1:] for b in boxes if b[0] == p]
        while rest:
            group = [rest.pop()]
            for a in group:
                near = [b for b in rest if a[0] - 10 <= b[2] and b[0] - 10 <= a[2] and a[1] - 10 <= b[3] and b[1] - 10 <= a[3]]
                rest = [b for b in rest if b not in near]
                group += near
            want[p, len(group)] += 1
    assert got == want


LEDGER = [(1, "b", "u", "dispatch", None, None), (2, "b", "u", "record", "s1", None), (3, "b", "u", "requeue", None, "changed"), (4, "b", "u", "dispatch", None, None), (5, "b", "u", "record", "s2", None), (6, "b", "u", "accept", None, None), (7, "b", "v", "dispatch", None, None)]


def ledger_frame(spark, rows):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(*r, at + datetime.timedelta(seconds=r[0])) for r in rows], stream.SCHEMA)


def test_ledger_state_does_not_depend_on_order(spark):
    rows = LEDGER + LEDGER[2:4]
    random.Random(6).shuffle(rows)
    got = {r.unit_id: r for r in ledger.state(ledger_frame(spark, rows)).collect()}
    assert (got["u"].last_kind, got["u"].output_sha, got["u"].last_reason, got["u"].n_dispatched) == ("accept", "s2", "changed", 2)
    assert got["v"].last_kind == "dispatch" and got["v"].output_sha is None
    assert ledger.state(ledger_frame(spark, [])).count() == 0
    assert sorted((r.unit_id, r.cycle, r.accepted) for r in ledger.cycles(ledger_frame(spark, rows)).collect()) == [("u", 1, False), ("u", 2, True), ("v", 1, False)]


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_streamed_state_equals_the_batch(spark, tmp_path, delay):
    for i, part in enumerate((LEDGER[4:], LEDGER[:3] + LEDGER[:1], LEDGER[3:4])):
        ledger_frame(spark, part).write.parquet(str(tmp_path / "in" / str(i)))
    source = stream.read(spark, str(tmp_path / "in" / "*"), files_per_trigger=1)
    stream.write(stream.state(source, delay), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    want = ledger.state(ledger_frame(spark, LEDGER))
    got = stream.latest(spark, str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_runs(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    assert df.columns and df.limit(1).count() <= 1


def test_units_chain_over_gaps_and_repeated_orders(spark, tmp_path):
    from quirework.plans.pages import units_chain

    rows = [("b", "u1", 1, "h1"), ("b", "u2", 4, "h2"), ("b", "u4", 5, "h4"), ("b", "u3", 5, "h3"), ("b", "u5", 6, "h5"), ("c", "u1", 3, "k1")]
    spark.createDataFrame(rows, "book_id string, unit_id string, ord int, source_hash string").write.parquet(f"{tmp_path}/units.parquet")
    got = sorted((r.book_id, r.unit_id, r.previous_hash) for r in units_chain(spark, str(tmp_path)).collect())
    assert got == [("b", "u1", "root"), ("b", "u2", "h1"), ("b", "u3", "h2"), ("b", "u4", "h3"), ("b", "u5", "h4"), ("c", "u1", "root")]


@pytest.mark.parametrize(
    "text,target,want",
    [("The iPhone sold well.", "iPhone", True), ("The Iphone sold well.", "iPhone", False), ("An iPhones' case", "iPhone", True), ("xiPhone", "iPhone", False), ("two strategies", "strategy", True), ("a.b", "a.b", True), ("axb", "a.b", False), ("压力表坏了", "压力表", True), ("a (b) c", "(b)", True)],
)
def test_targets_are_whole_words(spark, text, target, want):
    row = spark.createDataFrame([(text, target)], "a string, b string").select(glossary.target_present(F.col("a"), F.col("b")).alias("x")).first()
    assert row.x is want


def test_entries_hold_in_their_scope(spark):
    entries = [("g", "wheel", None, [], "confirmed", None), ("b", "wheel hub", None, [], "confirmed", ["book"]), ("n", "hub", None, [], "confirmed", ["n1"]), ("p", "wheel", None, ["hubs"], "pending", [])]
    texts = spark.createDataFrame([("1", "n1", "A wheel hub."), ("2", "n2", "A wheel hub."), ("3", None, "A hub.")], "k string, node string, text string")
    got = {(r.k, r.id) for r in glossary.selected(texts, spark.createDataFrame(entries, GLOSSARY + ", scopes array<string>"), ["k"], "node").collect()}
    assert got == {("1", "g"), ("1", "b"), ("1", "n"), ("2", "g"), ("2", "b")}


def test_tree_of_any_depth(spark):
    n = 21
    rows = [("b", f"n{i}", [f"n{i + 1}"] if i < n - 1 else []) for i in range(n)] + [("c", "n0", None)]
    got = {(r.book_id, r.id): (r.root_id, r.depth) for r in structure.tree(spark.createDataFrame(rows, "book_id string, id string, children array<string>")).collect()}
    assert got == {("b", f"n{i}"): ("n0", i) for i in range(n)} | {("c", "n0"): ("n0", 0)}


def test_units_hold_no_more_than_they_may(spark):
    rng = random.Random(2)
    rows = [("b", f"s{i}", i, rng.choice(["heading", "paragraph", "code"]), "word " * rng.choice([3, 300, 4000])) for i in range(60)] + [("b", "n", 99, "paragraph", None)]
    segments = spark.createDataFrame(rows, "book_id string, id string, ord int, kind string, text string")
    units = structure.pack_units(segments.unionByName(segments.limit(9)), target=6000, most=9000).collect()
    code = max(len(r[4]) for r in rows if r[3] == "code") + 2
    assert max(u.n_chars for u in units) <= max(9002, code) and sum(u.n_segments for u in units) == structure.split_long(segments, 9000).count()
    for u in units:
        assert u.n_segments == 1 or u.n_chars <= 6000


def test_pages_of_two_books_stay_apart(spark):
    rows = [("a", 1, 1, 600.0, 40.0, 80.0, 260.0, 400.0, "x" * 30), ("b", 1, 1, 600.0, 340.0, 80.0, 560.0, 400.0, "x" * 30)]
    got = layout.columns(spark.createDataFrame(rows, "book_id string, page int, block int, page_width double, x0 double, y0 double, x1 double, y1 double, text string")).collect()
    assert {(r.book_id, r.layout) for r in got} == {("a", "single_column"), ("b", "single_column")}
