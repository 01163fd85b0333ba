"""Queries that check translations: the aligned paragraphs, and stated pairs with stated faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import conservation as C
from quirework.operators import quality as Q
from quirework.plans import fixtures as X
from quirework.plans.registry import query
from quirework.session import table

SOURCE = """# 1 The Mill

The mill opened in 1998 with five looms and 12 workers, and it sold its cloth to all of the towns along the river for many years.

A second hall was built behind the first one. Its roof was made of slate, and the walls were painted white every spring by the workers themselves.

- oil the shaft
- clean the belt

| part | number |
|---|---|
| long belt | 10 |
| small wheel | 20 |

See [the plan](https://example.org/plan), Figure 3.1."""
TARGET = """# 1 磨坊

磨坊于1998年开业，拥有五台织机和12名工人，多年来向沿河的所有城镇出售布料。

第二座大厅建在第一座后面。屋顶由石板制成，墙壁每年春天由工人们自己刷成白色。

- 给轴上油
- 清洁皮带

| 部件 | 编号 |
|---|---|
| 长皮带 | 10 |
| 小轮 | 20 |

见[图纸](https://example.org/plan)，图3.1。"""
SECOND = TARGET.split("\n\n")[2]
OPENED = "1998年"
#: case, order, source, target, notes, and the findings it must give.
CASES: list[tuple[str, int, str, str, list[str], set[tuple[str, str]]]] = [
    ("unchanged", 1, SOURCE, TARGET, [], set()),
    ("copied", 1, SOURCE, SOURCE, [], {("content.untranslated", "fail")}),
    ("copied by design", 1, SOURCE, SOURCE, ["untranslated_by_design: a letter"], {("content.untranslated", "warn")}),
    ("copied without reason", 1, SOURCE, SOURCE, ["untranslated_by_design"], {("content.untranslated", "fail")}),
    ("paragraph lost", 1, SOURCE, TARGET.replace(SECOND + "\n\n", ""), [], {("content.block_coverage", "fail"), ("content.length_ratio", "fail")}),
    ("paragraph merged", 1, SOURCE, TARGET.replace("\n\n" + SECOND, SECOND), ["structure_reflowed: two in one"], {("content.block_coverage", "warn")}),
    ("paragraph merged bare", 1, SOURCE, TARGET.replace("\n\n" + SECOND, SECOND), ["structure_reflowed"], {("content.block_coverage", "fail")}),
    ("paragraph added", 1, SOURCE, TARGET + "\n\n译者注。", [], {("content.block_coverage", "warn")}),
    ("year changed", 1, SOURCE, TARGET.replace("1998", "1989"), [], {("content.numbers", "fail")}),
    ("year changed, other note", 1, SOURCE, TARGET.replace("1998", "1989"), ["typo in the source"], {("content.numbers", "fail")}),
    ("year rebuilt", 1, SOURCE, TARGET.replace("1998", "1989"), ["source_chart_lost"], {("content.numbers", "warn")}),
    ("count in digits", 1, SOURCE, TARGET.replace("五台", "5台"), [], {("content.numbers", "warn")}),
    ("count changed", 1, SOURCE, TARGET.replace("12", "13"), [], {("content.numbers", "fail")}),
    ("full-width year", 1, SOURCE, TARGET.replace("1998", "１９９８"), [], set()),
    ("year in ideographs", 1, SOURCE, TARGET.replace("1998", "一九九八"), [], set()),
    ("wrong year in ideographs", 1, SOURCE, TARGET.replace("1998", "一九八九"), [], {("content.numbers", "fail")}),
    ("year moved on", 1, SOURCE, TARGET.replace(OPENED, "某年"), [], {("content.numbers", "warn")}),
    ("year moved on", 2, "Its owner left.", "其主人1998年离开。", [], {("content.numbers", "warn")}),
    ("year also next door", 1, SOURCE, TARGET.replace(OPENED, "某年"), [], {("content.numbers", "fail")}),
    ("year also next door", 2, "Its owner left in 1998.", "其主人1998年离开。", [], set()),
    ("sentence left", 1, SOURCE, TARGET.replace("屋顶由石板制成，墙壁每年春天由工人们自己刷成白色。", "Its roof was made of slate, and the walls were painted white every spring by the workers themselves."), [], {("content.untranslated", "warn")}),
    ("list item lost", 1, SOURCE, TARGET.replace("\n- 清洁皮带", ""), [], {("content.block_coverage", "fail")}),
    ("table row lost", 1, SOURCE.replace("| small wheel | 20 |", "| small wheel | new |"), TARGET.replace("\n| 小轮 | 20 |", ""), [], {("structure.tables", "fail")}),
    ("link changed", 1, SOURCE, TARGET.replace("example.org/plan", "example.org/map"), [], {("content.urls", "fail")}),
    ("fence lost", 1, SOURCE + "\n\n```\nx\n```", TARGET, [], {("structure.code_fences", "fail")}),
    ("formula lost", 1, SOURCE + "\n\na = b", TARGET + "\n\na b", [], {("content.formulas", "fail")}),
    ("image changed", 1, SOURCE + "\n\n![](a.png)", TARGET + "\n\n![](b.png)", [], {("assets.image_refs", "fail")}),
    ("nothing written", 1, SOURCE, " ", [], {("unit.output", "fail")}),
]
PAIR_SCHEMA = "case string, ord int, source_text string, target_text string, source_issues array<string>"
WANTED = X.values("w", [(c, o, *f) for c, o, _, _, _, found in CASES for f in sorted(found)], "case string, ord int, check_id string, status string").replace("w(case,", 'w("case",')


@query("quality_cases", f'WITH {WANTED} SELECT "case", ord, check_id, status FROM w')
def quality_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated pairs, each with one fault, and what the checks must say about it."""
    pairs = spark.createDataFrame([row[:5] for row in CASES], PAIR_SCHEMA)
    found = Q.checks(pairs.withColumn("place", F.col("ord")), ["case"], "place", ["ord"])
    return found.select("case", "ord", "check_id", "status").distinct()


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.checks(table(spark, sf_dir, "alignment"), ["book_id"], "ord", ["id"], table(spark, sf_dir, "glossary"))


@query("quality_checks")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding about the confirmed paragraphs; the stated cases stand for it where SQL can't."""
    return _checked(spark, sf_dir)


@query("quality_scores")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score a book, from all its findings."""
    return C.score(_checked(spark, sf_dir), ["book_id"])


@query(
    "quality_keys",
    r"""
WITH c AS (SELECT book_id, id, list_distinct(regexp_extract_all(source_text, '(?i)\b(?:exhibit|figure|table)\s*([0-9]+(?:[.][0-9]+)*[A-Z]?)', 1)) AS a1, list_distinct(regexp_extract_all(source_text, '(?:图表|图|表)\s*([0-9]+(?:[.][0-9]+)*[A-Z]?)', 1)) AS a2,
  list_distinct(regexp_extract_all(target_text, '(?i)\b(?:exhibit|figure|table)\s*([0-9]+(?:[.][0-9]+)*[A-Z]?)', 1)) AS b1, list_distinct(regexp_extract_all(target_text, '(?:图表|图|表)\s*([0-9]+(?:[.][0-9]+)*[A-Z]?)', 1)) AS b2 FROM alignment),
k AS (SELECT book_id, id, CASE WHEN len(a1) > 0 THEN a1 ELSE a2 END AS a, CASE WHEN len(b1) > 0 THEN b1 ELSE b2 END AS b FROM c)
SELECT book_id, id, 'caption' AS what, unnest(list_filter(a, lambda x: NOT list_contains(b, x))) AS item, 'source' AS side FROM k
UNION ALL SELECT book_id, id, 'caption', unnest(list_filter(b, lambda x: NOT list_contains(a, x))), 'target' FROM k""",
)
def quality_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and captions that only one side of a confirmed paragraph has (paragraphs have no headings)."""
    return Q.key_difference(table(spark, sf_dir, "alignment"), ["book_id", "id"])
