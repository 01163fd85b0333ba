"""Markdown as columns, and the rewrites that need a parser as vectorised functions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirework.functions import text as T

#: Widest table that is set in one piece, in columns of the table and of the page.
TABLE_COLUMNS, TABLE_WIDTH = 5, 72

CAPTION = "(?i)(?<![\\p{L}])(exhibit|figure|fig\\.|table|chart|plate|illustration|map|\\x{56fe}\\x{8868}|\\x{63d2}\\x{56fe}|\\x{56fe}|\\x{8868})\\s*([0-9]+(?:[.\\x{2013}-][0-9]+)*[a-z]?)"
#: A code fence with its marks; one that is never closed goes to the text's end.
FENCE = "(?s)(?<![^\\n]) *(```|~~~).*?(?:\\n *\\1[^\\n]*|\\z)"


def _outside(text: Column, change) -> Column:
    """``change`` applied to the arrays of lines between code fences.

    A stretch has an empty line at each fence that it touches, which ``change`` must leave.
    """
    stretch = lambda x: F.array_join(change(F.split(x, "\n")), "\n")

    def fenced(t: Column) -> Column:
        between = F.transform(F.split(t, FENCE), stretch)
        fences = F.regexp_extract_all(t, F.lit(FENCE), F.lit(0))
        return F.array_join(F.zip_with(between, fences, lambda x, fence: F.concat(x, F.coalesce(fence, F.lit("")))), "")

    return T.bound(text, lambda t: F.when(F.contains(t, F.lit("```")) | F.contains(t, F.lit("~~~")), fenced(t)).otherwise(stretch(t)))


def outside_fences(text: Column, change) -> Column:
    """``change``, which leaves an empty line as it is, applied to every line outside code fences."""
    return _outside(text, lambda rows: F.transform(rows, change))


def html_headings(text: Column) -> Column:
    """``<h2>x</h2>`` as ``## x``."""
    for n in range(1, 7):
        text = F.regexp_replace(text, f"(?is)<h{n}(?:\\s[^>]*)?>\\s*(.*?)\\s*</h{n}>", "#" * n + " $1")
    return text


def superscripts(text: Column) -> Column:
    """Note marks ``<sup>[12]</sup>`` as ``^12^``."""
    return F.regexp_replace(text, "(?i)<sup[^>]*>\\s*\\[?(\\d{1,3})\\]?\\s*</sup>", "^$1^")


def drop_wrappers(text: Column) -> Column:
    """Without lines that hold only div or section tags, outside fences."""
    return _outside(text, lambda rows: F.filter(rows, lambda x: ~x.rlike("(?i)^\\s*(</?(?:div|section)\\b[^>]*>\\s*)+$")))


def anchors(text: Column) -> Column:
    """Identifiers that a text defines by attribute."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("\\bid\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1)))


def flatten_dead_links(text: Column) -> Column:
    """Links to identifiers that the text doesn't define, as plain words."""

    def flat(t: Column) -> Column:
        wanted = F.array_distinct(F.regexp_extract_all(t, F.lit("\\]\\(#([^)\\s]+)\\)"), F.lit(1)))
        # quoted, so that an identifier's own signs mean themselves
        return F.aggregate(F.array_except(wanted, anchors(t)), t, lambda x, name: F.regexp_replace(x, F.concat(F.lit("\\[([^\\]]*)\\]\\(#\\Q"), name, F.lit("\\E\\)")), F.lit("$1")))

    return T.bound(text, flat)


def table_rows(text: Column) -> Column:
    """Cells of the pipe rows of a table, separator rows left out."""
    rows = F.filter(T.lines(text), lambda x: x.contains("|") & ~is_separator(x))
    return F.transform(rows, cells)


def cells(line: Column) -> Column:
    bare = F.regexp_replace(F.trim(line), "^\\||\\|$", "")
    return F.transform(F.split(bare, "\\|"), lambda x: F.trim(x))


def is_separator(line: Column) -> Column:
    return line.rlike("^\\s*\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?\\s*$") & line.contains("|")


def pipe_tables(text: Column) -> Column:
    """Separator rows right under a row with pipes."""
    rows = T.lines(text)
    spots = F.transform(rows, lambda x, i: F.when((i > 0) & is_separator(x) & F.coalesce(F.get(rows, i - 1).contains("|"), F.lit(False)), 1).otherwise(0))
    return F.aggregate(spots, F.lit(0), lambda a, x: a + x)


def pipe_table(rows: Column, header: Column) -> Column:
    """Rows of cells as a pipe table; without a header the first row stays empty."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    n = F.array_max(F.transform(rows, F.size))
    blank, rule = F.array_repeat(F.lit(""), n), F.concat(F.lit("|"), F.repeat(F.lit("---|"), n))
    head = F.when(header, line(F.get(rows, F.lit(0)))).otherwise(line(blank))
    body = F.when(header, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    return F.concat_ws("\n", head, rule, F.when(F.size(body) > 0, F.array_join(F.transform(body, line), "\n")))


def list_items(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?m)^\\s*(?:[-*+]|\\d{1,3}[.)])\\s+"))


def caption_labels(text: Column) -> Column:
    """``class key`` of all exhibits that a text names, each once."""
    labels = F.regexp_extract_all(text, F.lit(CAPTION), F.lit(1))
    keys = F.regexp_extract_all(text, F.lit(CAPTION), F.lit(2))
    return F.array_distinct(F.transform(F.arrays_zip(labels.alias("a"), keys.alias("b")), lambda x: F.concat_ws(" ", T.caption_class(x["a"]), T.caption_key(x["b"]))))


class _Tables(HTMLParser):
    """Rows of the outermost tables; a nested table's text belongs to its cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            span = {k: min(int(v), 24) if (v or "").isdigit() else 1 for k, v in attrs}
            self.cell = [[], span.get("colspan", 1), span.get("rowspan", 1)]
            self.tables[-1][-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell[0].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        if self.depth <= 1 and tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0].append(data)


def html_table_grids(text: str) -> list[list[list[str]]]:
    """Each outermost HTML table as a rectangle of cells; spans are filled with blanks."""
    parser = _Tables()
    parser.feed(text)
    parser.close()
    grids = []
    for rows in parser.tables:
        grid: dict[tuple[int, int], str] = {}
        for r, row in enumerate(rows):
            c = 0
            for parts, across, down in row:
                while (r, c) in grid:
                    c += 1
                value = " ".join("".join(parts).split())
                for i in range(down):
                    for j in range(across):
                        grid[r + i, c + j] = value if i == j == 0 else ""
                c += across
        if grid:
            height, width = len(rows), max(c for _, c in grid) + 1
            grids.append([[grid.get((r, c), "") for c in range(width)] for r in range(height)])
    return grids


def _wide(text: str) -> int:
    import unicodedata

    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def grid_markdown(grid: list[list[str]]) -> str:
    """A grid as a pipe table whose separator dashes follow the widths of its columns."""
    width = [max(3, *(min(_wide(r[c]), 90) for r in grid)) for c in range(len(grid[0]))]
    line = lambda r: "| " + " | ".join(x.replace("|", "\\|") for x in r) + " |"
    return "\n".join([line(grid[0]), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, grid[1:])])


def split_wide(grid: list[list[str]], most: int = TABLE_COLUMNS, fit: int = TABLE_WIDTH) -> list[list[list[str]]]:
    """A grid too wide for a page in groups of columns, each beginning with the key column."""
    columns = len(grid[0])
    total = sum(max(_wide(r[c]) for r in grid) for c in range(columns)) + 3 * columns
    if columns <= most or total <= fit:
        return [grid]
    rest = list(range(1, columns))
    return [[[r[0], *(r[c] for c in rest[i : i + most - 1])] for r in grid] for i in range(0, len(rest), most - 1)]


_TABLE_TAG = re.compile(r"<(/?)table\b[^>]*>", re.I)


def outer_tables(text: str) -> list[tuple[int, int]]:
    """Spans of the outermost HTML tables; one that is never closed is none."""
    spans, depth, start = [], 0, 0
    for m in _TABLE_TAG.finditer(text):
        if not m.group(1):
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                spans.append((start, m.end()))
    return spans


def tables_as_markdown(text: str) -> str:
    out, at = [], 0
    for start, end in outer_tables(text):
        out += [text[at:start], "\n\n".join(grid_markdown(g) for grid in html_table_grids(text[start:end]) for g in split_wide(grid))]
        at = end
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def html_tables_as_markdown(texts: pd.Series) -> pd.Series:
    """HTML tables of each text as pipe tables; nested and malformed tables need a parser."""
    return texts.map(lambda t: tables_as_markdown(t) if t else t)
