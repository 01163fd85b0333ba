"""Arrays of lines: joining, cutting, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(lines: Column) -> Column:
    """Lines as one paragraph; a word divided at a line's end closes up if the next line goes on small."""

    def add(text: Column, line: Column) -> Column:
        line = F.trim(line)
        divided = text.rlike("\\p{L}-$") & line.rlike("^\\p{Ll}")
        return F.when(F.length(text) == 0, line).when(divided, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), line)).when(F.length(line) == 0, text).otherwise(F.concat(text, F.lit(" "), line))

    return F.aggregate(lines, F.lit(""), add)


def before_recovery(lines: Column, titles: list[str]) -> Column:
    """Lines up to the first recovery heading in the second half; all of them if there is none."""
    pattern = "(?i)^#{1,6}\\s+(" + "|".join(titles) + ")\\s*$"
    n = F.size(lines)
    spots = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern) & (i >= n / 2), i)), lambda i: i.isNotNull())
    return F.when(F.size(spots) > 0, F.slice(lines, F.lit(1), F.greatest(F.array_min(spots), F.lit(0)))).otherwise(lines)


def without_contents(lines: Column, title: str, after: str, marker: str = "[TOC]") -> Column:
    """A printed table of contents, from its title to the first title after it, replaced by a marker."""
    spot = lambda pattern, low: F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern) & (i > low), i)), lambda i: i.isNotNull()))
    start = spot(title, F.lit(-1))
    end = spot(after, F.coalesce(start, F.lit(1 << 30)))
    cut = F.concat(F.slice(lines, F.lit(1), start), F.array(F.lit(marker)), F.slice(lines, end + 1, F.size(lines) - end))
    return F.when(start.isNotNull() & end.isNotNull(), cut).otherwise(lines)


def first_title(lines: Column, most: int = 80) -> Column:
    """The first heading or wholly bold line of the first lines, without its marks."""
    head = F.filter(F.slice(lines, F.lit(1), F.lit(most)), lambda x: x.rlike("^#{1,6}\\s+\\S") | x.rlike("^\\*\\*[^*]+\\*\\*\\s*$"))
    return F.trim(F.regexp_replace(F.get(head, F.lit(0)), "^#{1,6}\\s+|\\*\\*", ""))


def is_bold(line: Column) -> Column:
    return line.rlike("^\\s*(\\*\\*[^*]+\\*\\*|__[^_]+__)\\s*$")


def is_running_folio(line: Column, page: Column) -> Column:
    """A short line without a sentence's marks that begins or ends with the number of its page."""
    return (F.length(line) <= 90) & ~line.rlike("[.!?;:\\x{3002}\\x{ff01}\\x{ff1f}]") & ((F.regexp_extract(line, "^(\\d+)\\b", 1) == page.cast("string")) | (F.regexp_extract(line, "\\b(\\d+)$", 1) == page.cast("string")))


def sort_key(key: Column) -> Column:
    """A key such as 6.10 as numbers, so that it comes after 6.9; letters count as 0."""
    return F.transform(F.split(key, "[.-]"), lambda x: F.coalesce(F.regexp_extract(x, "^(\\d+)", 1).try_cast("int"), F.lit(0)))


def list_context(lines: Column) -> Column:
    """Lines inside a list without the list's indent, others as they are."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("inside"))

    def add(state: Column, line: Column) -> Column:
        item = line.rlike("^\\s{0,3}([-*+]|\\d{1,3}[.)])\\s")
        inside = F.when(item, True).when(line.rlike("^\\S"), False).otherwise(state["inside"])
        bare = F.when(inside & ~item, F.regexp_replace(line, "^ {1,4}", "")).otherwise(line)
        return F.struct(F.concat(state["done"], F.array(bare)).alias("done"), inside.alias("inside"))

    return F.aggregate(lines, start, add, lambda s: s["done"])


def without_fragments(lines: Column) -> Column:
    """Lines without the run of label fragments at the end: short, without a sentence's mark."""
    fragment = lambda x: (F.length(F.trim(x)) <= 24) & ~x.rlike("[.!?:;\\x{3002}\\x{ff01}\\x{ff1f}]\\s*$") & ~x.rlike("^\\s*([#>|!-]|\\d+[.)])")
    last = F.array_max(F.transform(lines, lambda x, i: F.when(~fragment(x), i + 1).otherwise(0)))
    return F.slice(lines, F.lit(1), F.coalesce(last, F.lit(0)))
