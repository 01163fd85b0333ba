"""Blocks, the heading tree and work units."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import text as T
from quirework.session import cut, ship

#: Sizes of a work unit in characters, and what a segment costs beside its text.
TARGET, OVERHEAD = 6000, 2
#: Positions of a book that one window partition holds; larger books are put together from partial results.
BUCKET = 4096


def kind_of(block: Column) -> Column:
    """What a block is, by its first match: heading, code, image, table, list, paragraph."""
    rows = T.lines(block)
    n = F.size(rows)
    first = F.element_at(rows, 1)
    piped = F.forall(rows, lambda x: x.contains("|"))
    return (
        F.when((n == 1) & first.rlike(T.HEADING), "heading")
        .when(first.rlike("^\\s*(```|~~~)"), "code")
        .when((n <= 3) & block.rlike(T.IMAGE), "image")
        .when((piped & (n >= 2)) | block.rlike("^\\s*<table\\b[\\s\\S]*</table>\\s*$"), "table")
        .when(first.rlike("^\\s*([-*+] |\\d+[.)]\\s)"), "list")
        .otherwise("paragraph")
    )


def block_array(text: Column) -> Column:
    """The blocks of a text in order. A block ends at a blank line; inside a code fence blank lines belong to it."""
    body = F.regexp_replace(text, "\\r\\n?", "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit("").alias("fence"))

    def add(state: Column, line: Column) -> Column:
        mark = F.substring(F.ltrim(line), 1, 3)
        is_mark = mark.isin("```", "~~~")
        in_fence = F.length(state["fence"]) > 0
        closes = in_fence & (mark == state["fence"])
        opens = ~in_fence & is_mark
        blank = ~in_fence & (F.length(F.regexp_replace(line, "\\s", "")) == 0)
        joined = F.when(F.length(state["open"]) == 0, line).otherwise(F.concat(state["open"], F.lit("\n"), line))
        kept = F.when((blank | opens) & (F.length(state["open"]) > 0), F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        kept = F.when(closes, F.concat(state["done"], F.array(joined))).otherwise(kept)
        still = F.when(blank | closes, F.lit("")).when(opens, line).otherwise(joined)
        fence = F.when(opens, mark).when(closes, F.lit("")).otherwise(state["fence"])
        return F.struct(kept.alias("done"), still.alias("open"), fence.alias("fence"))

    def finish(state: Column) -> Column:
        return F.when(F.length(state["open"]) > 0, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])

    # without fences a blank line is all there is to look for
    plain = F.split(F.regexp_replace(body, "^(?:\\s*\\n)+|\\n\\s*$", ""), "\\n\\s*\\n")
    fenced = F.contains(body, F.lit("```")) | F.contains(body, F.lit("~~~"))
    parts = F.when(fenced, F.aggregate(F.split(body, "\n"), start, add, finish)).otherwise(plain)
    return F.filter(parts, lambda x: F.length(F.regexp_replace(x, "\\s", "")) > 0)


def blocks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a block: ``key, block_no, kind, heading_level, title, text``.

    Lines are grouped within each document by a fold over its own array, so
    nothing is shuffled. Null and blank texts have no blocks.
    """
    out = documents.select(F.col(key), F.posexplode(block_array(F.col(text))).alias("block_no", "text"))
    out = out.withColumn("block_no", F.col("block_no") + 1).withColumn("kind", kind_of(F.col("text")))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", T.HEADING, 1)))
    title = F.when(F.col("kind") == "heading", F.regexp_extract("text", T.HEADING, 2))
    return out.select(key, "block_no", "kind", level.alias("heading_level"), title.alias("title"), "text")


def once(segments: DataFrame, *columns: str) -> DataFrame:
    """Segments that were delivered twice count once; only the columns asked for are read."""
    return segments.select(*columns).distinct()


def once_after(segments: DataFrame, *columns: str, **computed: Column) -> DataFrame:
    """The same for what is computed from a text where it is read: of the text only a hash goes on, so no text is shuffled."""
    return segments.select(*columns, F.xxhash64("text").alias("_text"), *[v.alias(k) for k, v in computed.items()]).distinct().drop("_text")


def running_max(df: DataFrame, group: list[str], order: str, values: dict[str, Column], strict: bool = False, bucket: int = BUCKET) -> DataFrame:
    """The greatest of each value at or before each row (before it, if ``strict``) in the order of an integer column.

    Large groups are cut into buckets of positions: a window within each bucket,
    and the carry from the buckets before it, so that no task sorts a whole book.
    All values share one pass.
    """
    names = list(values)
    df = df.withColumns({f"_v_{k}": v for k, v in values.items()}).withColumn("_b", F.floor(F.col(order) / bucket))
    inside = Window.partitionBy(*group, "_b").orderBy(order).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*group, "_b").agg(*[F.max(f"_v_{k}").alias(f"_t_{k}") for k in names])
    carry = tops.select(*group, "_b", *[F.max(f"_t_{k}").over(before).alias(f"_c_{k}") for k in names])
    here = df.withColumns({f"_i_{k}": F.max(f"_v_{k}").over(inside) for k in names})
    out = here.join(carry, [*group, "_b"]).withColumns({k: F.greatest(f"_i_{k}", f"_c_{k}") for k in names})
    return out.drop("_b", *[f"_{x}_{k}" for x in "vic" for k in names])


def running_rank(df: DataFrame, group: list[str], order: str, ties: list[str], name: str, bucket: int = BUCKET) -> DataFrame:
    """The place of each row, from 0, in the order of an integer column and of ``ties`` after it.

    Places within buckets of positions and the counts of the buckets before, so
    that no task sorts a whole book.
    """
    df = df.withColumn("_b", F.floor(F.col(order) / bucket))
    inside = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(order, *ties)) - 1
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*group, "_b").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return df.withColumn("_i", inside).join(counts, [*group, "_b"]).withColumn(name, (F.col("_i") + F.col("_base")).cast("int")).drop("_b", "_i", "_base")


def assign_nodes(segments: DataFrame) -> DataFrame:
    """``node_ord``: the position of the latest heading at or before each segment; null before the first."""
    rows = once(segments, "book_id", "id", "ord", "kind")
    return running_max(rows, ["book_id"], "ord", {"node_ord": F.when(F.col("kind") == "heading", F.col("ord"))})


def heading_parents(segments: DataFrame) -> DataFrame:
    """Each heading with the nearest earlier heading of a smaller level.

    Six levels make six running maxima of positions; the greatest of those of
    smaller levels is the parent, so no self-join of headings is needed.
    """
    rows = once(segments.where(F.col("kind") == "heading"), "book_id", "id", "ord", "heading_level", "title")
    rows = rows.withColumn("level", F.coalesce("heading_level", F.lit(1)))
    rows = running_max(rows, ["book_id"], "ord", {f"last_{n}": F.when(F.col("level") == n, F.col("ord")) for n in range(1, 6)}, strict=True)
    none = F.lit(None).cast("int")
    smaller = [F.when(F.col("level") > n, F.col(f"last_{n}")).otherwise(none) for n in range(1, 6)]
    return rows.select("book_id", "id", "ord", "level", F.greatest(*smaller).alias("parent_ord"))


UNITS = "book_id string, node_ord int, unit_in_node int, first_ord int, last_ord int, n_segments int, n_chars int"


def pack_units(segments: DataFrame, target: int = TARGET, most: int | None = None) -> DataFrame:
    """Work units: consecutive segments of one node, filled while they fit; over-long segments are cut into pieces first.

    ``book_id, node_ord, unit_in_node, first_ord, last_ord, n_segments, n_chars``;
    pieces count as segments. A unit never spans two nodes. The rows of a node
    come sorted and are folded as they stream by: a task holds one open unit,
    however long a node is.
    """
    pieces = split_long(segments, most or HARD).select("book_id", "id", "ord", "kind", "part", (F.coalesce("n_chars", F.lit(0)) + OVERHEAD).cast("int").alias("size"))
    sized = running_max(pieces, ["book_id"], "ord", {"node_ord": F.when(F.col("kind") == "heading", F.col("ord"))})

    def fold(batches):
        key = open_ = None
        for batch in batches:
            out = []
            for book, node_ord, order, size in zip(*(batch.column(c).to_pylist() for c in ("book_id", "node_ord", "ord", "size")), strict=True):
                if key == (book, node_ord) and open_[5] + size <= target:
                    open_[3:] = order, open_[4] + 1, open_[5] + size
                    continue
                if open_:
                    out.append((key[0], key[1], *open_[1:]))
                open_ = [None, open_[1] + 1 if key == (book, node_ord) else 1, order, order, 1, size]
                key = (book, node_ord)
            yield _units(out)
        if open_:
            yield _units([(key[0], key[1], *open_[1:])])

    ship(segments.sparkSession)
    rows = sized.select("book_id", "node_ord", "ord", "part", "id", "size").repartition("book_id", "node_ord").sortWithinPartitions("book_id", "node_ord", "ord", "id", "part")
    return rows.mapInArrow(fold, UNITS)


def _units(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.strip().split(" ") for x in UNITS.split(",")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if t == "string" else pa.int32()) for v, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def tree(nodes: DataFrame) -> DataFrame:
    """``book_id, id, parent_id, root_id, depth`` of a node table with children arrays, of any depth.

    Each round replaces a node's ancestor by that one's own ancestor, so the
    distance doubles; after the third it is looked whether any is left.
    """
    parents = nodes.select("book_id", F.col("id").alias("parent_id"), F.explode("children").alias("id"))
    parents = parents.groupBy("book_id", "id").agg(F.min("parent_id").alias("parent_id"))
    rows = nodes.select("book_id", "id").distinct().join(parents, ["book_id", "id"], "left")
    out = rows.withColumns({"root_id": F.coalesce("parent_id", "id"), "depth": F.col("parent_id").isNotNull().cast("int")})
    above = out.where(F.col("depth") > 0).select("book_id", "id", "root_id", "depth")

    def round_(df: DataFrame, step: DataFrame) -> DataFrame:
        step = step.select("book_id", F.col("id").alias("root_id"), F.col("root_id").alias("_up"), F.col("depth").alias("_more"))
        return df.join(step, ["book_id", "root_id"], "left").withColumns({"depth": F.col("depth") + F.coalesce("_more", F.lit(0)), "root_id": F.coalesce("_up", "root_id")}).drop("_up", "_more")

    for _ in range(3):
        out, above = round_(out, above), round_(above, above)
    out = cut(out)
    last = parents.select("book_id", F.col("id").alias("root_id"))
    while not out.join(last, ["book_id", "root_id"], "left_semi").isEmpty():
        above = out.where(F.col("depth") > 0).select("book_id", "id", "root_id", "depth")
        out = cut(round_(out, above))
    return out.select("book_id", "id", "parent_id", "root_id", "depth")


def coverage(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments that the map names and the book lacks, or the other way round, as bags by book."""
    mapped = nodes.select("book_id", F.explode("segment_ids").alias("id")).withColumn("n", F.lit(1))
    present = once(segments, "book_id", "id").withColumn("n", F.lit(-1))
    both = mapped.unionByName(present).groupBy("book_id", "id").agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    return both.select("book_id", "id", F.when(F.col("n") > 0, "only_mapped").otherwise("unmapped").alias("side"), F.abs("n").cast("int").alias("n"))


def unit_problems(units: DataFrame, segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is wrong with a unit table: repeated keys and orders, gaps, segments and nodes that don't exist."""
    found = lambda df, key, what: df.select("book_id", F.expr(key).cast("string").alias("unit_id"), F.lit(what).alias("problem"))
    twice = units.groupBy("book_id", "unit_id").count().where("count > 1")
    orders = units.groupBy("book_id", "ord").count().where("count > 1")
    gaps = units.groupBy("book_id").agg(F.max("ord").alias("top"), F.countDistinct("ord").alias("n")).where("top + 1 <> n")
    ids = units.select("book_id", "unit_id", F.explode("segment_ids").alias("id"))
    lost = ids.join(segments.select("book_id", "id"), ["book_id", "id"], "left_anti").select("book_id", "unit_id").distinct()
    nodeless = units.join(nodes.select("book_id", F.col("id").alias("book_node_id")), ["book_id", "book_node_id"], "left_anti")
    out = found(twice, "unit_id", "duplicate_id").unionByName(found(orders, "ord", "duplicate_order")).unionByName(found(gaps, "null", "order_gap"))
    return out.unionByName(found(lost, "unit_id", "missing_segment")).unionByName(found(nodeless, "unit_id", "missing_node"))


def unit_hashes(units: DataFrame, segments: DataFrame) -> DataFrame:
    """Each unit's recorded hash and the hash of its segments' texts now."""
    ids = units.select("book_id", "unit_id", "source_hash", F.posexplode("segment_ids").alias("pos", "id"))
    texts = once(segments, "book_id", "id", "text")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    whole = ids.join(texts, ["book_id", "id"], "left").groupBy("book_id", "unit_id").agg(F.first("source_hash").alias("source_hash"), ordered.alias("texts"), F.count("text").alias("n_found"), F.count("*").alias("n_segments"))
    body = F.concat(F.regexp_replace(F.array_join("texts", "\n\n"), "\\s+$", ""), F.lit("\n"))
    current = F.sha2(body, 256)
    return whole.select("book_id", "unit_id", "source_hash", current.alias("current_hash"), (current.eqNullSafe(F.col("source_hash"))).alias("fits"), F.col("n_segments").cast("int").alias("n_segments"), F.col("n_found").cast("int").alias("n_found"))


def samples(units: DataFrame, count: int = 7) -> DataFrame:
    """Evenly spaced units of each book: positions round(i * (n - 1) / (count - 1)), each once."""
    n = units.groupBy("book_id").agg((F.max("ord") + 1).alias("n"))
    spots = n.select("book_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"), "n")
    picked = spots.select("book_id", F.bround(F.col("i") * (F.col("n") - 1) / (count - 1)).cast("int").alias("ord")).distinct()
    return units.select("book_id", "unit_id", "ord").join(picked, ["book_id", "ord"], "left_semi")


def with_identifiers(headings: DataFrame, group: str, order: str, title: str = "title") -> DataFrame:
    """Identifiers of headings; the second and later of one name in a group get a number."""
    named = headings.withColumn("_key", T.identifier(F.col(title)))
    again = F.row_number().over(Window.partitionBy(group, "_key").orderBy(order)) - 1
    return named.withColumn("_n", again).withColumn("identifier", F.when(F.col("_n") == 0, F.col("_key")).otherwise(F.concat_ws("-", "_key", F.col("_n").cast("string")))).drop("_key", "_n")


# Where an over-long segment may be cut, the best marks first.
SPLIT_MARKS = (("\n",), ("。", "！", "？", ". ", "! ", "? "), ("；", "; ", "，", ", "), (" ",))
HARD = 9000


def cut_positions(text: str, most: int) -> list[int]:
    """Ends of the pieces of an over-long text: after the last mark of the best class in the second half of the limit."""
    ends, at = [], 0
    while len(text) - at > most:
        cut = at + most
        for marks in SPLIT_MARKS:
            best = max((p + len(m) for m in marks if (p := text.rfind(m, at, at + most)) >= 0), default=-1)
            if best - at >= most // 2:
                cut = best
                break
        ends.append(cut)
        at = cut
        while at < len(text) and text[at].isspace():
            at += 1
    return [*ends, len(text)] if at < len(text) else ends


def split_long(segments: DataFrame, most: int = HARD) -> DataFrame:
    """Pieces of segments for work units: over-long ones are cut at marks, code and tables never.

    Only over-long rows reach Python; the others are measured where they are
    read. A row delivered twice counts once, by a hash of its text.
    """
    long = (F.length("text") > most) & ~F.col("kind").isin("code", "table")
    whole = once_after(segments.where(~F.coalesce(long, F.lit(False))), "book_id", "id", "ord", "kind", part=F.lit(0), n_chars=F.length("text"))

    def pieces(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                start = 0
                mark = hashlib.blake2b(row.text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                for k, end in enumerate(cut_positions(row.text, most), 1):
                    piece = row.text[start:end]
                    piece = piece.lstrip() if k > 1 else piece
                    out.append((row.book_id, row.id, row.ord, row.kind, mark, k, len(piece if end == len(row.text) else piece.rstrip())))
                    start = end
            yield pd.DataFrame(out, columns=["book_id", "id", "ord", "kind", "mark", "part", "n_chars"])

    ship(segments.sparkSession)
    found = segments.where(long).select("book_id", "id", "ord", "kind", "text").mapInPandas(pieces, "book_id string, id string, ord int, kind string, mark string, part int, n_chars int")
    return whole.unionByName(found.distinct().drop("mark"))
