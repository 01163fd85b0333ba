"""Problem 6: clean text from HTML, Markdown, wiki or LaTeX markup.

Markdown, wiki and LaTeX constructs are rewritten as elements; a tree builder
with implied end tags and visibility rules then reads the whole, and a renderer
that minds layout emits every visible text: blocks apart, lists with their
marks, tables as aligned cells, code and formulas untouched.

In the clean text a heading has ``#`` marks, list items ``-`` or numbers, code
a fence or backquotes, a formula dollar signs, a table one line of pipes a row.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.arrow import map_batches

# Element names of HTML, and of wiki text, that are markup when they stand in angle brackets.
ELEMENTS = (
    "a abbr acronym address article aside audio b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark math "
    "meta nav nowiki object ol option p pre q ref references s samp script section select small source span strike strong style sub summary sup svg "
    "table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
VOID = frozenset("br col hr img input link meta source wbr".split())
HIDDEN = frozenset("script style head template title meta link svg iframe object select textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre references section summary table tbody td tfoot th thead tr ul formula".split()
)
#: An element of this name ends the open element of the names given.
IMPLIED = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "tbody": {"thead", "tr", "td", "th", "p"}, "option": {"option"},
}
ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)(" + "|".join(sorted(ELEMENTS, key=len, reverse=True)) + r")((?:\s[^<>]*)?)(/?)>", re.I | re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(\bhidden\b)""")

# LaTeX commands known by name even without an argument.
LATEX_BARE = "item ldots dots textbackslash LaTeX TeX par noindent newline linebreak maketitle tableofcontents hline centering quad qquad bigskip medskip smallskip clearpage newpage"
_MATH = re.compile(r"\$\$.+?\$\$|\$(?!\s*\d[\d.,]*\s+[a-z]{2,})(?:\\.|[^$\n\\])+\$", re.S)

#: What makes a segment one with markup, by language. Formulas in dollar signs are blanked before.
DETECT = {
    "html": re.compile(_TAG.pattern, re.I | re.S),
    "wiki": re.compile(
        r"\[\[[^\[\]\n]+\]\]|(?<!')'{2,5}(?=[^'\s])[^'\n]*(?:'[^'\n]+)*?'{2,5}(?!')|^={2,6}[ \t]*[^=\n]+?[ \t]*={2,6}[ \t]*$|\{\{[^{}\n]+\}\}|^\{\|"
        r"|\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]+)?\]|^(?:[*#]{2,}|[*#][:*#])[ \t]*\S|<ref[ />]",
        re.M,
    ),
    "markdown": re.compile(
        r"(?<![^\W぀-鿿])(?<!\*)\*\*(?=[^\s*])[^\n]+?(?<=[^\s*])\*\*(?![^\W぀-鿿])(?!\*)|(?<![^\W぀-鿿])__(?=[^\s_])[^\n]+?(?<=[^\s_])__(?![^\W぀-鿿])|~~(?=\S)[^\n~]+?(?<=\S)~~|(?<!`)`(?!`)[^`\n]+`(?!`)"
        r"|(?<![^\W぀-鿿])(?<!\*)\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![^\W぀-鿿])(?!\*)|(?<![^\W぀-鿿])(?<!_)_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![^\W぀-鿿])(?!_)"
        r"|!?\[[^\[\]\n]*\]\([^()\s]+(?:\s\"[^\"\n]*\")?\)|\[\^[\w-]+\]|^>[ \t]|^[^\n]*\w[^\n]*\n(?:={3,}|-{3,})[ \t]*$|^(?:```|~~~)",
        re.M,
    ),
    "latex": re.compile(
        r"(?<![\w:\\])\\(?:begin|end)\{\w+\*?\}|(?<![A-Za-z0-9:\\])\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|(?<![A-Za-z0-9:\\])\\(?:" + "|".join(LATEX_BARE.split()) + r")(?![A-Za-z\\])"
        r"|\\\(.+?\\\)|\\\[.+?\\\]|(?<=[\w\d ])\\[%&#_$]|``(?!`)[^`'\n]+''",
        re.S,
    ),
}
_HEADING_LINES = re.compile(r"^#{1,6}[ \t]+\S", re.M)
_LIST_LINES = re.compile(r"^(?:[ \t]*[-*+][ \t]+(?!\d+[ \t]+-$)\S.*\n?){2,}|^\*[ \t]+\[\[", re.M)


def languages(text: str, kind: str | None) -> list[str]:
    """Markup languages of which ``text`` holds a construct beyond the marks of its kind."""
    if kind in ("code", "image"):
        return []
    body = text
    if kind == "heading":
        body = re.sub(r"(?m)^#{1,6}[ \t]+", "", body)
    elif kind == "list":
        body = re.sub(r"(?m)^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+", "", body)
    elif kind == "table":
        body = re.sub(r"(?m)^\|(?:[ \t]*:?-{2,}:?[ \t]*\|)+[ \t]*$", "", body)
    plain = _MATH.sub(" ", body)
    found = [name for name, pattern in DETECT.items() if pattern.search(plain)]
    if "html" not in found and any(m.group()[1] == "#" or m.group()[1:] in html5 for m in _ENTITY.finditer(plain)):
        found.append("html")
    if "markdown" not in found and kind not in ("heading", "list", "table") and (_HEADING_LINES.search(plain) or _LIST_LINES.search(plain)):
        found.append("markdown")
    return found


# --- other languages as elements -------------------------------------------------


class _Kept:
    """Stretches that no later rule may touch stand as private-use marks meanwhile."""

    def __init__(self) -> None:
        self.items: list[str] = []

    def put(self, element: str) -> str:
        self.items.append(element)
        return f"\ue000{len(self.items) - 1}\ue001"

    def back(self, text: str) -> str:
        while True:
            new = re.sub("\ue000(\\d+)\ue001", lambda m: self.items[int(m.group(1))] if int(m.group(1)) < len(self.items) else "", text)
            if new == text:
                break
            text = new
        return text


def _code(kept: _Kept, text: str, block: bool, language: str = "") -> str:
    inner = html.escape(text.strip("\n"), quote=False)
    return kept.put(f'<pre lang="{language}">{inner}</pre>' if block else f"<code>{inner}</code>")


def _formula(kept: _Kept, text: str, block: bool) -> str:
    inner = html.escape(text.strip(), quote=False)
    return kept.put(f"<formula>{inner}</formula>" if block else f"<math>{inner}</math>")


def _latex(text: str, kept: _Kept) -> str:
    text = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]]*\])?(?:\{\w+\})?(.*?)\\end\{\1\}", lambda m: _code(kept, m.group(2), True), text, flags=re.S)
    text = re.sub(r"\\begin\{(equation|align|gather|multline|displaymath|eqnarray|math)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: _formula(kept, m.group(3), True), text, flags=re.S)
    text = re.sub(r"\\\[(.+?)\\\]", lambda m: _formula(kept, m.group(1), True), text, flags=re.S)
    text = re.sub(r"\\\((.+?)\\\)", lambda m: _formula(kept, m.group(1), False), text, flags=re.S)
    text = re.sub(r"\\begin\{tabular\*?\}(?:\{[^{}]*\})+(.*?)\\end\{tabular\*?\}", lambda m: _latex_table(m.group(1)), text, flags=re.S)
    for env, element in (("itemize", "ul"), ("enumerate", "ol"), ("description", "ul"), ("quote", "blockquote"), ("quotation", "blockquote"), ("abstract", "p"), ("center", "div"), ("figure", "figure"), ("table", "div"), ("document", "div")):
        text = re.sub(rf"\s*\\begin\{{{env}\*?\}}(?:\[[^\]]*\])?", f"<{element}>", text)
        text = re.sub(rf"\s*\\end\{{{env}\*?\}}", f"</{element}>", text)
    text = re.sub(r"\s*\\item\b(?:\[([^\]]*)\])?\s*", lambda m: "<li>" + (f"{m.group(1)}: " if m.group(1) else ""), text)
    text = re.sub(r"(?<![A-Za-z0-9:\\])\\(?:ldots|dots)(?:\{\})?", "…", text)
    levels = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
    while True:  # the innermost braces first, until none are left
        text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: f"<h{levels[m.group(1)]}>{m.group(2)}</h{levels[m.group(1)]}>", text)
        text = re.sub(r"~?\\(?:label|cite[pt]?|citep|index|vspace|hspace|includegraphics|usepackage|bibliography\w*|pagestyle)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", text)
        text = re.sub(r"\\(?:ref|eqref|pageref|autoref)\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
        text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\(?:texttt|verb)\{([^{}]*)\}", lambda m: _code(kept, m.group(1), False), text)
        new = re.sub(r"(?<![A-Za-z0-9:\\])\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
        if new == text:
            break
        text = new
    text = re.sub(r"``([^`'\n]+)''", "“\\1”", text)
    text = re.sub(r"(?<![A-Za-z0-9:\\])\\(?:" + "|".join(LATEX_BARE.split()) + r")(?:\{\})?(?![A-Za-z\\])[ \t]?", " ", text)
    text = re.sub(r"(?<![A-Za-z0-9:\\])\\(?:begin|end)\{\w+\*?\}", "", text)
    text = re.sub(r"\\([%&#_$])", lambda m: html.escape(m.group(1), quote=False), text)
    return text.replace("~", " ") if "~" in text and "~~" not in text else text


def _latex_table(body: str) -> str:
    rows = [r for r in re.split(r"\\\\(?:\[[^\]]*\])?", re.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", body)) if r.strip()]
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c.strip()}</td>" for c in re.split(r"(?<!\\)&", r)) + "</tr>" for r in rows) + "</table>"


def _wiki(text: str, kept: _Kept) -> str:
    text = re.sub(r"^\{\|[^\n]*\n(.*?)^\|\}", lambda m: _wiki_table(m.group(1)), text, flags=re.S | re.M)
    text = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: kept.put(html.escape(m.group(1), quote=False)), text, flags=re.S)
    text = re.sub(r"<ref[^<>/]*>(.*?)</ref>", r" (\1)", text, flags=re.S)
    text = re.sub(r"<ref[^<>]*/>", "", text)
    while (new := re.sub(r"\{\{([^{}\n]+)\}\}", lambda m: _template(m.group(1)), text)) != text:
        text = new
    text = re.sub(r"\[\[(?:[Ff]ile|[Ii]mage):[^\[\]\n]*?(?:\|([^\[\]|\n]*))?\]\]", lambda m: m.group(1) or "", text)
    text = re.sub(r"\[\[[Cc]ategory:[^\[\]\n]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"\[((?:https?|ftp)://[^\s\]]+)\]", r"\1", text)
    text = re.sub(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", lambda m: f"<h{len(m.group(1))}>{m.group(2)}</h{len(m.group(1))}>", text, flags=re.M)
    return re.sub(r"(?<!')('{2,5})(?=[^'\s])(.*?)\1(?!')", r"<b>\2</b>", text)


def _template(body: str) -> str:
    """The visible part of a template: unnamed arguments; of a citation its title and year."""
    name, *arguments = body.split("|")
    named = dict(a.split("=", 1) for a in arguments if "=" in a)
    if name.strip().lower().startswith(("cite", "citation")):
        return " (" + ", ".join(named[k].strip() for k in ("author", "title", "year") if named.get(k)) + ")" if named else ""
    return " ".join(a.strip() for a in arguments if "=" not in a)


def _wiki_table(body: str) -> str:
    rows: list[list[str]] = [[]]
    for line in body.split("\n"):
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            continue
        elif line[:1] in "!|" and line:
            tag = "th" if line[0] == "!" else "td"
            for cell in re.split(r"!!|\|\|", line[1:]):
                rows[-1].append(f"<{tag}>{cell.split('|')[-1].strip()}</{tag}>")
    return "<table>" + "".join("<tr>" + "".join(r) + "</tr>" for r in rows if r) + "</table>"


def _inline(text: str) -> str:
    text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\s]+(?:\s\"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"\[([^\[\]\n]*)\]\([^()\s]+(?:\s\"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"\[\^([\w-]+)\]", r"[\1]", text)
    text = re.sub(r"(?<![^\W぀-鿿])(?<!\*)\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*(?![^\W぀-鿿])(?!\*)", r"<b>\1</b>", text)
    text = re.sub(r"(?<![^\W぀-鿿])__(?=[^\s_])(.+?)(?<=[^\s_])__(?![^\W぀-鿿])", r"<b>\1</b>", text)
    text = re.sub(r"~~(?=\S)([^\n~]+?)(?<=\S)~~", r"<s>\1</s>", text)
    text = re.sub(r"(?<![^\W぀-鿿])(?<!\*)\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![^\W぀-鿿])(?!\*)", r"<i>\1</i>", text)
    return re.sub(r"(?<![^\W぀-鿿])(?<!_)_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![^\W぀-鿿])(?!_)", r"<i>\1</i>", text)


def _markdown(text: str, kept: _Kept, lists: bool) -> str:
    text = re.sub(r"^(```|~~~)(\w*)[^\n]*\n(.*?)(?:^\1[ \t]*$|\Z)", lambda m: _code(kept, m.group(3), True, m.group(2)), text, flags=re.S | re.M)
    text = re.sub(r"(?<!`)`(?!`)([^`\n]+)`(?!`)", lambda m: _code(kept, m.group(1), False), text)
    text = re.sub(r"^([^\n]*\w[^\n]*)\n(={3,}|-{3,})[ \t]*$", lambda m: f"<h{1 if m.group(2)[0] == '=' else 2}>{m.group(1).strip()}</h{1 if m.group(2)[0] == '=' else 2}>", text, flags=re.M)
    text = re.sub(r"^(#{1,6})[ \t]+([^\n]*?)[ \t]*#*$", lambda m: f"<h{len(m.group(1))}>{m.group(2)}</h{len(m.group(1))}>", text, flags=re.M) if not lists else text
    if lists:
        text = re.sub(r"(?:^[*#]+[ \t]*[^\n]*\n?)+", lambda m: _wiki_list(m.group()), text, flags=re.M)
    text = re.sub(r"(?:^>[ \t]?[^\n]*\n?)+", lambda m: "<blockquote>" + re.sub(r"(?m)^>[ \t]?", "", m.group()) + "</blockquote>", text, flags=re.M)
    return _inline(text)


def _wiki_list(block: str) -> str:
    out, open_ = [], ""
    for line in block.strip("\n").split("\n"):
        marks, rest = re.match(r"([*#]+)[ \t]*(.*)", line).groups()
        same = 0
        while same < min(len(open_), len(marks)) and open_[same] == marks[same]:
            same += 1
        out += ["</ul>" if c == "*" else "</ol>" for c in reversed(open_[same:])]
        out += ["<ul>" if c == "*" else "<ol>" for c in marks[same:]]
        open_ = marks
        out.append(f"<li>{rest}")
    out += ["</ul>" if c == "*" else "</ol>" for c in reversed(open_)]
    return "".join(out) + "\n"


# --- tree -----------------------------------------------------------------------


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None) -> None:
        self.name, self.attrs, self.children = name, attrs or {}, []


_ALL = re.compile(r"<!--.*?(?:-->|$)|<(/?)(formula|" + "|".join(sorted(ELEMENTS, key=len, reverse=True)) + r")((?:\s[^<>]*)?)(/?)>", re.I | re.S)


def build(source: str) -> Node:
    """The tree of ``source``: missing end tags are implied, stray ones ignored."""
    root = Node("body")
    stack = [root]
    open_: Counter[str] = Counter()

    def drop(i: int) -> None:
        open_.subtract(n.name for n in stack[i:])
        del stack[i:]

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(html.unescape(value) if "&" in value else value)

    def close(names: set[str], scope: set[str]) -> None:
        if not any(open_[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in scope:
                return
            if stack[i].name in names:
                drop(i)

    at = 0
    for m in _ALL.finditer(source):
        text(source[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1) if open_[name] else ():
                if stack[i].name == name:
                    drop(i)
                    break
                if stack[i].name in ("td", "th", "table") and name not in ("tr", "table", "tbody", "thead", "tfoot"):
                    break
            continue
        if name in IMPLIED:
            close(IMPLIED[name], SCOPE.get(name, set()))
        elif name in ENDS_PARAGRAPH and stack[-1].name == "p":
            drop(len(stack) - 1)
        attrs = {(a or c).lower(): b.strip("\"'") for a, b, c in _ATTRIBUTE.findall(m.group(3) or "")}
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name not in VOID and not m.group(4):
            stack.append(node)
            open_[name] += 1
    text(source[at:])
    return root


def _visible(node: Node) -> bool:
    style = node.attrs.get("style", "").replace(" ", "").lower()
    return node.name not in HIDDEN and "hidden" not in node.attrs and "display:none" not in style and "visibility:hidden" not in style


def _wide(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


# --- layout ---------------------------------------------------------------------


def _run(job: Iterator) -> object:
    """Run a generator that yields the generators it waits for; trees may be of any depth."""
    jobs, value = [job], None
    while jobs:
        try:
            jobs.append(jobs[-1].send(value))
            value = None
        except StopIteration as end:
            jobs.pop()
            value = end.value
    return value


def render(root: Node) -> str:
    """Visible text, blocks on lines of their own."""
    lines: list[str] = []
    buffer: list[str] = []
    prefix = [""]

    def flush(gap: bool = False) -> None:
        value = "".join(buffer)
        buffer.clear()
        for part in value.split("\n"):
            part = re.sub(r"[ \t\f\r]+", " ", part).strip(" ")
            if part:
                lines.append(prefix[-1] + part)
        if gap and lines and lines[-1].strip():
            lines.append("")

    def inside(node: Node) -> Iterator:
        for child in node.children:
            if isinstance(child, str):
                buffer.append(child)
            elif _visible(child):
                yield walk(child)

    def inline(node: Node) -> Iterator:
        keep = list(buffer)
        buffer.clear()
        yield inside(node)
        out = re.sub(r"\s+", " ", "".join(buffer)).strip()
        buffer[:] = keep
        return out

    def items(node: Node) -> Iterator:
        number = 0
        for child in node.children:
            if isinstance(child, Node) and child.name == "li" and _visible(child):
                flush()
                number += 1
                mark = f"{number}. " if node.name == "ol" else "- "
                start = len(lines)
                prefix.append(prefix[-1] + " " * len(mark))
                yield inside(child)
                flush()
                own = prefix.pop()
                if len(lines) > start:
                    lines[start] = prefix[-1] + mark + lines[start][len(own) :]
            elif isinstance(child, str):
                if child.strip():
                    buffer.append(child)
            elif _visible(child):
                yield walk(child)

    def walk(node: Node) -> Iterator:
        name = node.name
        if name == "br":
            buffer.append("\n")
        elif name == "hr":
            flush()
            lines.append("")
        elif name == "img":
            if node.attrs.get("alt"):
                buffer.append(f" {html.unescape(node.attrs['alt'])} ")
        elif name == "pre":
            flush()
            lines.append(f"{prefix[-1]}```{node.attrs.get('lang', '')}")
            lines.extend(prefix[-1] + x for x in _raw(node).strip("\n").split("\n"))
            lines.append(f"{prefix[-1]}```")
        elif name in ("code", "kbd", "samp", "tt"):
            buffer.append(f"`{_raw(node)}`")
        elif name == "math":
            buffer.append(f"${_raw(node)}$")
        elif name == "formula":
            flush()
            lines.append(f"{prefix[-1]}$${_raw(node)}$$")
        elif name in ("sup", "sub"):
            value = yield inline(node)
            buffer.append(("^" if name == "sup" else "_") + value if value else "")
        elif name[0] == "h" and name[1:].isdigit():
            flush(True)
            title = yield inline(node)
            lines.extend(("#" * int(name[1:]) + " " + title, ""))
        elif name in ("ul", "ol"):
            flush()
            yield items(node)
            flush()
        elif name == "table":
            flush()
            rows = yield _table(node, inline)
            lines.extend(prefix[-1] + row for row in rows)
        elif name == "blockquote":
            flush()
            prefix.append(prefix[-1] + "> ")
            yield inside(node)
            flush()
            prefix.pop()
        elif name in BLOCKS:
            flush()
            yield inside(node)
            flush(name in ("p", "section", "article"))
        elif name != "wbr":
            yield inside(node)

    _run(inside(root))
    flush()
    while lines and not lines[-1].strip():
        lines.pop()
    while lines and not lines[0].strip():
        lines.pop(0)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines))


def _raw(node: Node) -> str:
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.name == "br":
            out.append("\n")
        else:
            todo.extend(reversed(c.children))
    return "".join(out)


def _span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "1")
    return min(int(value), 1000) if value.isdigit() and len(value) < 10 and int(value) else 1


def _table(node: Node, inline) -> Iterator:
    """Lines of a table; a cell that spans columns or rows leaves the others it covers empty."""
    rows: list[list[str]] = []
    header = False
    covered: dict[int, int] = {}  # column -> rows that a cell above still covers
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if not isinstance(c, Node) or not _visible(c):
            continue
        if c.name == "tr":
            cells = [x for x in c.children if isinstance(x, Node) and x.name in ("td", "th")]
            if not rows and cells and all(x.name == "th" for x in cells):
                header = True
            row: list[str] = []
            below = {k: n - 1 for k, n in covered.items() if n > 1}
            for x in cells:
                while covered.get(len(row)):
                    row.append("")
                value = yield inline(x)
                for k in range(_span(x, "colspan")):
                    if _span(x, "rowspan") > 1:
                        below[len(row)] = _span(x, "rowspan") - 1
                    row.append("" if k else value.replace("|", "\\|"))
            while covered.get(len(row)):
                row.append("")
            covered = below
            rows.append(row)
        elif c.name == "caption":
            rows.append([(yield inline(c))])
        elif c.name != "table":
            todo.extend(reversed(c.children))
    rows = [r for r in rows if r]
    if not rows:
        return []
    columns = max(map(len, rows))
    rows = [r + [""] * (columns - len(r)) for r in rows]
    width = [max(3, *(_wide(r[i]) for r in rows)) for i in range(columns)]
    out = ["| " + " | ".join(c + " " * (w - _wide(c)) for c, w in zip(r, width, strict=True)) + " |" for r in rows]
    if header:
        out.insert(1, "|" + "|".join("-" * (w + 2) for w in width) + "|")
    return out


class Cleaned(NamedTuple):
    text: str
    languages: list[str]


def clean(text: str, kind: str | None) -> Cleaned:
    """Clean text of one segment, and the markup languages found in it; a text without markup is returned as it is.

    ``languages`` only says what a text may hold; it counts as found if its
    constructs become elements of the tree.
    """
    maybe = languages(text, kind)
    if not maybe:
        return Cleaned(text, [])
    mark = ""
    body = text
    if kind == "heading" and (m := re.match(r"#{1,6}[ \t]+", body)):
        mark, body = m.group(), body[m.end() :]
    kept = _Kept()
    body = body.replace("\ue000", "").replace("\ue001", "")
    found: list[str] = []

    def step(language: str, new: str) -> str:
        if new != body and language not in found:
            found.append(language)
        return new

    body = step("html", re.sub(r"<pre[^<>]*>(.*?)</pre>", lambda m: kept.put("<pre>" + html.escape(html.unescape(re.sub(r"</?[a-z]+[^<>]*>", "", m.group(1))), quote=False) + "</pre>"), body, flags=re.S | re.I))
    body = step("html", re.sub(r"<(code|kbd|samp|tt)(?:\s[^<>]*)?>(.*?)</\1>", lambda m: kept.put(f"<code>{html.escape(html.unescape(m.group(2)), quote=False)}</code>"), body, flags=re.S | re.I))
    body = _MATH.sub(lambda m: kept.put(f"<formula>{html.escape(m.group()[2:-2].strip(), quote=False)}</formula>" if m.group().startswith("$$") else html.escape(m.group(), quote=False)), body)
    if "html" in maybe and "html" not in found:
        children = build(body).children
        if len(children) != 1 or children[0] != body:
            found.append("html")
    if "latex" in maybe:
        body = step("latex", _latex(body, kept))
    if "wiki" in maybe:
        body = step("wiki", _wiki(body, kept))
    if "markdown" in maybe or "wiki" in maybe:
        language = "markdown" if "markdown" in maybe else "wiki"
        if kind == "list":
            body = step(language, "\n".join(_line_in_list(x, kept) for x in body.split("\n")))
        elif kind == "table":
            body = step(language, _inline(body))
        else:
            if "markdown" in maybe and _LIST_LINES.search(body):
                found.append(language)  # a list of its own stays as it is written
            body = step(language, _markdown(body, kept, "wiki" in maybe and bool(re.search(r"(?m)^(?:[*#]{2,}|\*[ \t])", body))))
    if not found:
        return Cleaned(text, [])
    found = [x for x in ("html", "wiki", "markdown", "latex") if x in found]
    if kind == "list":
        return Cleaned("\n".join(_keep_indent(x, kept) for x in body.split("\n")), found)
    return Cleaned(mark + render(build(kept.back(body))), found)


def _line_in_list(line: str, kept: _Kept) -> str:
    indent, rest = re.match(r"([ \t]*(?:[-*+][ \t]+|\d{1,9}[.)][ \t]+)?)(.*)", line, re.S).groups()
    return indent + _inline(re.sub(r"(?<!`)`(?!`)([^`\n]+)`(?!`)", lambda m: _code(kept, m.group(1), False), rest))


def _keep_indent(line: str, kept: _Kept) -> str:
    indent, rest = re.match(r"([ \t]*(?:[-*+][ \t]+|\d{1,9}[.)][ \t]+)?)(.*)", line, re.S).groups()
    return indent + render(build(kept.back(rest)))


CLEAN = "book_id string, id string, kind string, text string, languages array<string>"
#: Rows without any of these signs hold no markup of any language.
SIGNS = "[<&*_~`\\\\{\\[=^]|''|(^|\\n)(>|#{1,6} |-{3}|[-+] )"


def clean_segments(segments: DataFrame, only_found: bool = False) -> DataFrame:
    """``text`` of every segment as clean text, with the markup languages found in it.

    Needs ``book_id, id, kind, text``; other columns are ignored. Null text stays
    null with no language, empty text stays empty, a null kind is treated as a
    paragraph, code and image segments come back unchanged, a row delivered
    twice gives equal rows. With ``only_found`` a sign test in the scan's stage
    keeps plain rows from Python. There is no shuffle.
    """
    rows = segments.select(F.col("book_id").cast("string"), F.col("id").cast("string"), F.col("kind").cast("string"), F.col("text").cast("string"))
    if only_found:
        kind = F.coalesce(F.col("kind"), F.lit(""))
        body = F.when(kind == "heading", F.regexp_replace("text", "^#+ ", "")).when(kind == "list", F.regexp_replace("text", "(?m)^\\s*[-*+] ", "")).otherwise(F.col("text"))
        rows = rows.where(F.col("text").isNotNull() & ~kind.isin("code", "image") & body.rlike(SIGNS))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("book_id", "id", "kind", "text", "languages")}
        for book, key, kind, text in zip(*(batch.column(c).to_pylist() for c in ("book_id", "id", "kind", "text")), strict=True):
            cleaned = clean(text, kind) if text else Cleaned(text, [])
            if cleaned.languages or not only_found:
                for column, value in zip(out.values(), (book, key, kind, *cleaned), strict=True):
                    column.append(value)
        return {k: pa.array(v, pa.list_(pa.string()) if k == "languages" else pa.string()) for k, v in out.items()}

    return map_batches(rows, ["book_id", "id", "kind", "text"], run, CLEAN)
