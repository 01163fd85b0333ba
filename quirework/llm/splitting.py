"""Problem 3: splitting oversized segments at natural boundaries.

A segment over the limit is parsed into a tree: sections by heading level, in
them fences, tables, lists and paragraphs, in a list its items by indent, in a
table its rows, in code its definitions. Sibling subtrees are merged bottom-up
while they fit; only a node that is itself too large is opened, and a leaf that
is too large gives its lines, sentences, clauses and words. A text with no
boundary at all is cut between characters.

Lossless: without the overlap the pieces joined in order give the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.arrow import map_batches

LIMIT = 9000
OVERLAP = 200

PIECES = "book_id string, id string, kind string, heading_level int, piece_no int, n_pieces int, start_at int, end_at int, overlap int, boundary string, text string"

_FENCE = re.compile(r"(?m)^[ \t]{0,3}(```+|~~~+)[^\n]*(?:\n|\Z)")
_WHOLE = re.compile(r"(?is)<(pre|script|style)\b[^<>]*>.*?(?:</\1>[ \t]*\n?|\Z)|<!--.*?(?:-->[ \t]*\n?|\Z)")
_HEADING = re.compile(r"(?mi)^(#{1,6})[ \t]|<h([1-6])[ >]")
_UNDERLINE = re.compile(r"\n(?:(=)=+|--+)[ \t]*(?=\n|\Z)")
_BLANK = re.compile(r"\n(?:[ \t]*\n)+")
_BLOCK_END = re.compile(r"(?i)</(?:table|ul|ol|dl|div|section|article|blockquote|p)>\s*")
_ITEM = re.compile(r"(?m)^([ \t]*)(?:[-*+•]|\d{1,9}[.)])[ \t]")
_TAGGED_ITEM = re.compile(r"(?i)</(?:li|dd)>\s*")
_ROW = re.compile(r"(?i)</tr>\s*|\n(?=[ \t]*\|)")
_DEFINITION = re.compile(r"(?<!\n)\n[ \t]*\n+(?=\S)")
#: Where a leaf may be cut, the coarsest first.
_FINE = (
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[”’」』）]*")),
    ("clause", re.compile(r"(?<=[;:])\s+|(?<=[；：])")),
    ("clause", re.compile(r"(?<=,)\s+|(?<=[，、])")),
    ("word", re.compile(r"\s+")),
)
_FINE_CODE = (_FINE[0], _FINE[-1])
_JOINED = re.compile("[\u0300-\u036f\u200d\ufe00-\ufe0f\u20d0-\u20ff]")


class Node(NamedTuple):
    """A stretch of the text; ``parts`` of an inner node cover it without gaps. ``fine`` tells how a leaf is cut."""

    start: int
    end: int
    name: str
    parts: list[Node]
    fine: tuple = _FINE


def _leaves(text: str, start: int, end: int, pattern: re.Pattern, name: str, fine: tuple = _FINE) -> list[Node]:
    edges = [start, *sorted({p for m in pattern.finditer(text, start, end) if start < (p := m.end()) < end}), end]
    return [Node(a, b, name, [], fine) for a, b in zip(edges, edges[1:], strict=False)]


def _whole_spans(text: str) -> list[tuple[int, int]]:
    """Fences, preformatted elements and comments: no mark inside them is one of the text's."""
    spans: list[tuple[int, int]] = []
    at = 0
    while m := _FENCE.search(text, at):
        mark = m.group(1)
        close = re.compile(rf"(?m)^[ \t]{{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*(?:\n|\Z)").search(text, m.end())
        spans.append((m.start(), close.end() if close else len(text)))
        at = spans[-1][1]
    fences = [a for a, _ in spans]
    for m in _WHOLE.finditer(text):
        k = bisect_left(fences, m.end())  # the fences before this one end before it starts, or overlap
        if not k or spans[k - 1][1] <= m.start():
            spans.append(m.span())
    return sorted(spans)


def _code(text: str, start: int, end: int) -> Node:
    parts = _leaves(text, start, end, _DEFINITION, "definition", _FINE_CODE)
    parts = [Node(n.start, n.end, n.name, inner if len(inner := _leaves(text, n.start, n.end, _BLANK, "block", _FINE_CODE)) > 1 else [], _FINE_CODE) for n in parts]
    return Node(start, end, "block", parts if len(parts) > 1 else parts[0].parts, _FINE_CODE)


def _list(text: str, start: int, end: int) -> Node:
    """Items by indent: an item holds those indented deeper that follow it."""
    marks = [(m.start(), len(m.group(1).expandtabs(4))) for m in _ITEM.finditer(text, start, end)]
    if len(marks) < 2:
        return Node(start, end, "block", inner if len(inner := _leaves(text, start, end, _TAGGED_ITEM, "item")) > 1 else [])

    def items(low: int, high: int, begin: int, stop: int) -> list[Node]:
        """Nodes of marks[low:high], which cover text[begin:stop]."""
        out = []
        i = low
        while i < high:
            j = i + 1
            while j < high and marks[j][1] > marks[i][1]:
                j += 1
            a, b = begin if i == low else marks[i][0], marks[j][0] if j < high else stop
            pending.append((len(out), out, i + 1, j, b) if j > i + 1 else None)
            out.append(Node(a, b, "item", []))
            i = j
        return out

    pending: list = []
    root = Node(start, end, "block", items(0, len(marks), start, end))
    while pending:
        if job := pending.pop():
            place, siblings, low, high, stop = job
            node = siblings[place]
            head = Node(node.start, marks[low][0], "item", [])
            siblings[place] = node._replace(parts=[head, *items(low, high, marks[low][0], stop)])
    return root


def _block(text: str, start: int, end: int) -> Node:
    """One block by what it begins with."""
    body = text[start:end].lstrip()
    if _ITEM.match(body) or re.match(r"(?i)<(?:ul|ol|dl)\b", body):
        return _list(text, start, end)
    if body.startswith("|") or re.match(r"(?i)<table\b", body):
        rows = _leaves(text, start, end, _ROW, "row")
        return Node(start, end, "block", rows if len(rows) > 1 else [])
    return Node(start, end, "block", [])


def _blocks(text: str, start: int, end: int, whole: list[tuple[int, int]]) -> list[Node]:
    """The blocks of text[start:end]; a whole span is one."""
    first = max(0, bisect_left(whole, (start, 0)) - 1)
    own = [(max(a, start), min(b, end)) for a, b in whole[first : bisect_left(whole, (end, 0))] if start < b]
    out: list[Node] = []
    at = start
    for a, b in [*own, (end, end)]:
        if at < a:
            edges = {p for pattern in (_BLANK, _BLOCK_END) for m in pattern.finditer(text, at, a) if at < (p := m.end()) < a}
            edges = [at, *sorted(edges), a]
            out += [_block(text, x, y) for x, y in zip(edges, edges[1:], strict=False)]
        if a < b:
            out.append(_code(text, a, b))
        at = max(at, b)
    # a blank stretch belongs to the block before it
    kept: list[Node] = []
    for node in out:
        if kept and not text[node.start : node.end].strip():
            last = kept.pop()
            kept.append(Node(last.start, node.end, last.name, [*last.parts[:-1], last.parts[-1]._replace(end=node.end)] if last.parts and not last.parts[-1].parts else [], last.fine))
        else:
            kept.append(node)
    return kept


def parse(text: str, kind: str | None = None, heading_level: int | None = None) -> Node:
    """The tree of a segment. A heading's own text has ``heading_level``: only headings below it are its sections."""
    if kind == "code":
        return _code(text, 0, len(text))
    whole = _whole_spans(text)
    found = [(m.start(), len(m.group(1)) if m.group(1) else int(m.group(2))) for m in _HEADING.finditer(text)]
    for m in _UNDERLINE.finditer(text):
        line = text.rfind("\n", 0, m.start()) + 1
        if re.search(r"\w", text[line : m.start()]):
            found.append((line, 1 if m.group(1) else 2))
    headings: list[tuple[int, int]] = []
    for at, level in sorted(found):
        k = bisect_left(whole, (at + 1, 0)) - 1
        if (k < 0 or whole[k][1] <= at) and not (headings and headings[-1][0] == at):
            headings.append((at, level))
    if kind == "heading" and heading_level:
        headings = [(0, heading_level), *(h for h in headings if h[0] > 0)]
    if not headings:
        blocks = _blocks(text, 0, len(text), whole)
        return blocks[0]._replace(name="text") if len(blocks) == 1 else Node(0, len(text), "text", blocks)
    # sections by level, on a stack of open ones: [level, start, parts]
    stack: list[list] = [[0, 0, _blocks(text, 0, headings[0][0], whole) if headings[0][0] else []]]

    def close(level: int, end: int) -> None:
        while len(stack) > 1 and stack[-1][0] >= level:
            _, start, parts = stack.pop()
            stack[-1][2].append(Node(start, end, "heading", parts if len(parts) > 1 else parts[0].parts, parts[0].fine if len(parts) == 1 else _FINE))

    for (at, level), end in zip(headings, [*(h[0] for h in headings[1:]), len(text)], strict=True):
        close(level, at)
        stack.append([level, at, _blocks(text, at, end, whole)])
    close(1, len(text))
    return Node(0, len(text), "text", stack[0][2])


def pack(text: str, kind: str | None, limit: int, heading_level: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces of ``text``, each at most ``limit`` long.

    ``boundary`` names what begins at the cut before the piece. Siblings share a
    piece while they fit; the pieces of an opened node are its own.
    """
    if len(text) <= limit:
        return [(0, len(text), "text")]
    out: list[tuple[int, int, str]] = []
    todo: list[Node | None] = [parse(text, kind, heading_level)]
    room = False  # whether the last piece may still take a sibling
    first: str | None = None  # the name of the cut at which an opened node begins
    while todo:
        node = todo.pop()
        if node is None:  # the end of an opened node
            room = False
            continue
        size = node.end - node.start
        if size > limit:
            parts = node.parts or _cut_leaf(text, node, limit)
            room, first = False, first or node.name
            todo.append(None)
            todo.extend(reversed(parts))
        elif room and node.end - out[-1][0] <= limit:
            out[-1] = (out[-1][0], node.end, out[-1][2])
        else:
            out.append((node.start, node.end, first or node.name))
            room, first = True, None
    return [(a, b, "text" if a == 0 else name) for a, b, name in out]


def _cut_leaf(text: str, node: Node, limit: int) -> list[Node]:
    """The parts of an oversized leaf by its coarsest boundaries; between characters where it has none."""
    for k, (name, pattern) in enumerate(node.fine):
        parts = _leaves(text, node.start, node.end, pattern, name, node.fine[k + 1 :])
        if len(parts) > 1:
            return parts
    out, start = [], node.start
    while node.end - start > limit:
        cut = start + limit
        while cut > start + 1 and _JOINED.match(text, cut):
            cut -= 1
        if cut == start + 1:
            cut = start + limit
        out.append(Node(start, cut, "character", []))
        start = cut
    return [*out, Node(start, node.end, "character", [])]


def split_oversized(segments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, once: bool = True) -> DataFrame:
    """Pieces of every segment longer than ``limit`` characters (code points).

    Needs ``book_id, id, kind, text, heading_level``; other columns are ignored.
    Each piece but the first begins with the last ``overlap`` characters of the
    one before, so ``text`` of a piece is ``source[start_at - overlap : end_at]``
    and never over ``limit``. Null or short text gives no row, an empty table no
    rows, a null kind is treated as a paragraph, a null level of a heading as
    that of its marks, a key with two different texts gives the pieces of both.
    A row delivered twice counts once, or gives its pieces twice if not ``once``.

    The length filter runs in the scan's stage, so only oversized rows reach
    Python; they alone are shuffled to find repeated ones, and nothing is if not
    ``once``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to less than limit")
    large = segments.select(
        F.col("book_id").cast("string"), F.col("id").cast("string"), F.col("kind").cast("string"), F.col("heading_level").cast("int"), F.col("text").cast("string")
    ).where(F.char_length("text") > limit)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("book_id", "id", "kind", "heading_level", "piece_no", "n_pieces", "start_at", "end_at", "overlap", "boundary", "text")}
        for row in batch.to_pylist():
            text = row["text"]
            pieces = pack(text, row["kind"], limit - overlap, row["heading_level"])
            for i, (a, b, boundary) in enumerate(pieces):
                repeated = min(overlap, a)
                values = (row["book_id"], row["id"], row["kind"], row["heading_level"], i + 1, len(pieces), a, b, repeated, boundary, text[a - repeated : b])
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
        ints = ("heading_level", "piece_no", "n_pieces", "start_at", "end_at", "overlap")
        return {k: pa.array(v, pa.int32() if k in ints else pa.string()) for k, v in out.items()}

    return map_batches(large.dropDuplicates() if once else large, ["book_id", "id", "kind", "heading_level", "text"], run, PIECES)
