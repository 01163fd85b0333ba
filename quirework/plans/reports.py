"""Queries that roll up findings, pages, exhibits and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import ledger as LG
from quirework.operators import reports as R
from quirework.plans import fixtures as X
from quirework.plans import ledger as PL
from quirework.plans.registry import query
from quirework.session import table

MOST = 3


@query(
    "ledger_stages",
    f"""WITH {PL.STATE}, r AS (SELECT u.book_id, st.output_sha, coalesce(st.last_reason = 'attempt_limit' AND st.last_kind = 'requeue' AND st.n_dispatched >= {MOST}, false) AS given_up
  FROM (SELECT DISTINCT book_id, unit_id FROM units) u LEFT JOIN st USING (book_id, unit_id))
SELECT book_id, count(*) AS n_units, count(output_sha) AS n_done, CASE WHEN bool_or(given_up) THEN 'failed_terminal' WHEN count(*) = count(output_sha) THEN 'completed' ELSE 'pending' END AS status FROM r GROUP BY book_id""",
)
def ledger_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each book is."""
    return R.stages(LG.state(table(spark, sf_dir, "ledger")), table(spark, sf_dir, "units"), MOST)


RECORDS = [("a", 2, 1.5, 100, 40, 0.25, "eur"), ("a", 1, None, 50, None, 0.5, None), ("a", None, 2.0, None, 5, None, "EUR"), ("b", 1, 3.0, 10, 10, 1.0, "EUR")]
RECORD_SCHEMA = "book_id string, attempts int, duration_seconds double, input_tokens int, output_tokens int, cost double, currency string"
REC = X.values("r", RECORDS, RECORD_SCHEMA)


@query("reports_metrics", f"WITH {REC} SELECT book_id, CAST(sum(attempts) AS BIGINT) AS attempts, sum(duration_seconds) AS duration_seconds, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM r GROUP BY book_id")
def reports_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unit_metrics(X.frame(spark, RECORDS, RECORD_SCHEMA), ["book_id"])


@query("reports_costs", f"WITH {REC} SELECT book_id, upper(coalesce(currency, 'USD')) AS currency, sum(cost) AS cost FROM r WHERE cost IS NOT NULL GROUP BY ALL")
def reports_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unit_costs(X.frame(spark, RECORDS, RECORD_SCHEMA), ["book_id"])


ITEMS = [("a", "figure", "1", 3, 1, 0), ("a", "figure", "1", 4, 0, 2), ("a", "table", "1", 4, 0, 1), ("b", "figure", "1", 1, 1, 1)]
ITEM_SCHEMA = "book_id string, class string, key string, page int, n_images int, n_drawings int"


@query("reports_exhibits", f"WITH {X.values('i', ITEMS, ITEM_SCHEMA)} SELECT book_id, class, key, string_agg(page, ',' ORDER BY page) AS pages, CAST(sum(n_images) AS BIGINT) AS n_images, CAST(sum(n_drawings) AS BIGINT) AS n_drawings FROM i GROUP BY ALL")
def reports_exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.exhibits_by_key(X.frame(spark, ITEMS, ITEM_SCHEMA))
    return found.withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


PAGES = [("a", 1, "single_column", False, None, 10, 0), ("a", 2, "mixed", False, None, 10, 1), ("a", 3, "single_column", True, "completed", 0, 1), ("a", 4, "single_column", True, "failed", 0, 1), ("a", 5, "single_column", False, None, 0, 0), ("b", 2, "single_column", False, "unavailable", 9, 0)]
PAGE_SCHEMA = "book_id string, page int, layout string, scanned boolean, ocr_status string, n_chars int, n_images int"
REGIONS = [("a", 1, 1), ("a", 1, 3), ("a", 2, 1), ("b", 2, 0)]
REGION_SCHEMA = "book_id string, page int, risk int"


@query(
    "reports_pages",
    f"""WITH {X.values('p', PAGES, PAGE_SCHEMA)}, {X.values('g', REGIONS, REGION_SCHEMA)}
SELECT p.book_id, p.page, greatest(CASE WHEN scanned OR ocr_status IN ('unavailable', 'failed') THEN 3 WHEN layout IN ('multi_column', 'mixed') THEN 2 ELSE 0 END, coalesce((SELECT max(risk) FROM g WHERE g.book_id = p.book_id AND g.page = p.page), 0)) AS risk,
  CAST(CASE WHEN scanned THEN CASE WHEN ocr_status = 'completed' THEN 0.65 ELSE 0 END WHEN layout IN ('multi_column', 'mixed') THEN 0.55 ELSE 1 END AS DOUBLE) AS confidence, CASE WHEN n_chars = 0 AND n_images = 0 THEN 'blank' WHEN page = 1 THEN 'cover' ELSE 'body' END AS kind FROM p""",
)
def reports_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_conditions(X.frame(spark, PAGES, PAGE_SCHEMA), X.frame(spark, REGIONS, REGION_SCHEMA))


FINDINGS = [("u1", "content.numbers", "warn"), ("u2", "content.numbers", "warn"), ("u1", "structure.tables", "warn"), ("u3", "content.urls", "fail"), ("u3", "assets.image_refs", "warn")]
EXCEPTIONS = [("e1", "content.numbers", "u1", "approved"), ("e2", "structure.tables", "book", "approved"), ("e3", "assets.image_refs", "u3", "pending")]


@query("reports_unapproved", "SELECT * FROM (VALUES ('u2', 'content.numbers', 'warn'), ('u3', 'assets.image_refs', 'warn')) t(unit_id, check_id, status)")
def reports_unapproved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings that nobody has agreed to."""
    return R.unapproved(X.frame(spark, FINDINGS, "unit_id string, check_id string, status string"), X.frame(spark, EXCEPTIONS, "id string, check_id string, scope string, status string"), "unit_id")


SCORES = [("a", "u1", 1, 0.5), ("a", "u2", 1, 0.1), ("a", "u2", 2, 0.1), ("a", "u3", 1, 0.0), ("b", "u2", 7, 0.02)]
SCORE_SCHEMA = "book_id string, unit string, page int, score double"


@query("reports_best_page", f"WITH {X.values('s', SCORES, SCORE_SCHEMA)} SELECT book_id, unit, arg_max(page, (score, -page)) AS page FROM s WHERE score > 0 AND NOT (book_id = 'a' AND unit = 'u1') GROUP BY ALL")
def reports_best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best page of units that no page took."""
    scores = X.frame(spark, SCORES, SCORE_SCHEMA)
    return R.best_page(scores, scores.where("score >= 0.12").select("book_id", "unit", "page"))


@query("reports_median_size", f"WITH {X.values('b', X.ROLES, X.ROLE_SCHEMA)} SELECT book_id, page, CAST(coalesce(median(CASE WHEN NOT is_image THEN size END), 10) AS DOUBLE) AS median FROM b GROUP BY ALL")
def reports_median_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.median_size(X.frame(spark, X.ROLES, X.ROLE_SCHEMA))


BOXES = [(1, "right", 10.0, 10.0, 20.0, 110.0, 40.0, 112.0, 20.0), (2, "up", None, 10.0, 20.0, 22.0, 200.0, 10.0, 5.0), (3, "slant", 8.0, 0.0, 0.0, 50.0, 50.0, 60.0, 60.0), (4, "down", 40.0, 0.0, 0.0, 50.0, 90.0, 0.0, 95.0)]
BOX_SCHEMA = "pos int, direction string, size double, x0 double, y0 double, x1 double, y1 double, next_x0 double, next_y0 double"


@query(
    "reports_boxes",
    f"""WITH {X.values('b', BOXES, BOX_SCHEMA)}, d AS (SELECT *, CASE WHEN direction IN ('up', 'down') THEN least((x1 - x0) * 0.25, coalesce(size, x1 - x0) * 0.3) ELSE 0.5 END AS dx, CASE WHEN direction = 'right' THEN least((y1 - y0) * 0.25, coalesce(size, y1 - y0) * 0.3) ELSE 0.5 END AS dy FROM b)
SELECT pos, CAST(CASE direction WHEN 'right' THEN next_x0 - x1 WHEN 'up' THEN y0 - (next_y0 + 10) WHEN 'down' THEN next_y0 - y1 END AS DOUBLE) AS gap, CAST(x0 + dx AS DOUBLE) AS x0, CAST(y0 + dy AS DOUBLE) AS y0, CAST(x1 - dx AS DOUBLE) AS x1, CAST(y1 - dy AS DOUBLE) AS y1 FROM d""",
)
def reports_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between spans, and boxes that can't touch the lines beside them."""
    c = F.col
    box = (c("x0"), c("y0"), c("x1"), c("y1"))
    after = (c("next_x0"), c("next_y0"), c("next_x0") + 10, c("next_y0") + 10)
    return X.frame(spark, BOXES, BOX_SCHEMA).select("pos", R.span_gap(c("direction"), box, after).alias("gap"), *R.inner_box(c("direction"), c("size"), box))


COUNTS = [("a", 1, "10 mm", 2), ("a", 2, "x", 1), *[("a", 3 + i, f"n{i}", 1) for i in range(6)], ("b", 1, "y", 3)]


@query("reports_compact", f"WITH {X.values('c', COUNTS, 'k string, pos int, item string, n int')}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos, item) AS p FROM c) SELECT k, string_agg(item || '×' || n, ', ' ORDER BY p) AS items FROM r WHERE p <= 6 GROUP BY k")
def reports_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_compact(X.frame(spark, COUNTS, "k string, pos int, item string, n int"), ["k"], "pos")
