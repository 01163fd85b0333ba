"""Markdown made fit for setting: images, links, captions, roles and residue."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions import markdown as M
from quirework.functions import text as T

# Roles that a checker of EPUB packages accepts on a link.
ROLES = "button checkbox doc-backlink doc-biblioref doc-glossref doc-noteref link menuitem menuitemcheckbox menuitemradio option radio switch tab treeitem".split()
#: A paragraph under an image that is no longer than this is its caption.
CAPTION_CHARS = 80
#: A printer's stamp, looked for once a word: from its first letter or where the stamp before it ends.
STAMP = "(?i)(?:\\G|(?<![\\w.-]))[\\w.-]+\\.(?:qxd|indd)\\s+\\d+/\\d+/\\d+\\s+\\d+:\\d\\d\\s+[AP]M(?:\\s+Page\\s+\\S+)?"
#: What every text with residue holds; lines in fences may hold it too.
RESIDUE = "(?im)<!--|\\.(?:qxd|indd)\\s|(?:\\\\|[ \\t]{2})$|[\\x{2022}\\x{25aa}\\x{25cf}]\\s"


def _for_each(pattern: str, text: Column, change) -> Column:
    """``text`` with every stretch that the pattern's first group finds replaced by what ``change`` makes of it."""
    return T.bound(text, lambda whole: F.aggregate(F.array_distinct(F.regexp_extract_all(whole, F.lit(pattern), F.lit(1))), whole, lambda t, x: F.replace(t, x, change(x))))


def images(text: Column) -> Column:
    """HTML images as Markdown; an image that is a link is the image alone."""
    text = F.regexp_replace(text, "(?i)<img\\b(?=[^>]*\\bsrc\\s*=\\s*[\"']([^\"']+)[\"'])(?=[^>]*\\balt\\s*=\\s*[\"']([^\"']*)[\"'])[^>]*>", "![$2]($1)")
    text = F.regexp_replace(text, "(?i)<img\\b[^>]*\\bsrc\\s*=\\s*[\"']([^\"']+)[\"'][^>]*>", "![]($1)")
    return F.regexp_replace(text, "\\[(!\\[[^\\]]*\\]\\([^)]*\\))\\]\\([^)]*\\)", "$1")


def lift_images(text: Column) -> Column:
    """Images of a heading on a line of their own below it."""

    def lift(line: Column) -> Column:
        pictures = F.regexp_extract_all(line, F.lit("(!\\[[^\\]]*\\]\\([^)]*\\))"), F.lit(1))
        bare = F.rtrim(F.regexp_replace(F.regexp_replace(line, "\\s*!\\[[^\\]]*\\]\\([^)]*\\)", ""), "\\s{2,}", " "))
        return F.when(line.rlike("^#{1,6}\\s.*!\\["), F.concat(bare, F.lit("\n\n"), F.array_join(pictures, "\n"))).otherwise(line)

    return M.outside_fences(text, lift)


def flatten_page_links(text: Column) -> Column:
    """Links to other pages of a package, as plain words; those to the web and within the page stay."""
    return F.regexp_replace(text, "(?<!!)\\[([^\\]]*)\\]\\((?![a-z]+:|#)[^)\\s]*\\.x?html?(?:#[^)\\s]*)?\\)", "$1")


def slashes(text: Column) -> Column:
    """Forward slashes in the paths of sources and links."""
    return _for_each("(?i)\\b(?:src|href)\\s*=\\s*[\"']([^\"']*\\\\[^\"']*)[\"']", text, lambda x: F.replace(x, F.lit("\\"), F.lit("/")))


def known_roles(text: Column) -> Column:
    """Links without role attributes that checkers don't accept there."""
    role = "\\s+role\\s*=\\s*[\"'](?!(?:" + "|".join(ROLES) + ")[\"'])[^\"']*[\"']"
    return F.regexp_replace(text, f"(?i)(<a\\b[^>]*?){role}([^>]*>)", "$1$2")


def bind_captions(xhtml: Column) -> Column:
    """An image paragraph and the short caption paragraph after it as one figure."""
    label = "(?i:figure|fig\\.|table|chart|exhibit|\\x{56fe}|\\x{8868})\\s*[0-9]"
    return F.regexp_replace(xhtml, f"<p>\\s*(<img\\b[^>]*>)\\s*</p>\\s*<p>\\s*({label}[^<]{{0,{CAPTION_CHARS - 9}}})</p>", "<figure>$1<figcaption>$2</figcaption></figure>")


def split_captions(text: Column) -> Column:
    """A bold caption that runs on at the end of a paragraph, as a block of its own."""
    return F.regexp_replace(text, "(?m)(?<=\\S)[ \\t]+(\\*\\*(?i:exhibit|figure|fig\\.|table|chart)\\s+[0-9][^*\\n]*\\*\\*)[ \\t]*$", "\n\n$1")


def residue(text: Column) -> Column:
    """Without comments, printer's stamps, hard breaks and odd bullets, outside fences."""

    def line(x: Column) -> Column:
        x = F.regexp_replace(x, "<!--.*?-->", "")
        x = F.regexp_replace(x, STAMP, "")
        x = F.regexp_replace(x, "(?:\\\\|(?<![ \\t])[ \\t]{2,})$", "")
        return F.regexp_replace(x, "^(\\s*)[\\x{2022}\\x{25aa}\\x{25cf}]\\s+", "$1- ")

    return T.bound(text, lambda t: F.when(t.rlike(RESIDUE), M.outside_fences(t, line)).otherwise(t))


#: The steps of ``clean`` in order, each with signs of which every text that it changes holds one (residue looks for its own).
STEPS = (
    (residue, ("",)),
    (slashes, ("\\",)),
    (M.html_headings, ("</",)),
    (M.superscripts, ("</",)),
    (images, ("<", "](")),
    (lift_images, ("![",)),
    (M.drop_wrappers, ("<",)),
    (flatten_page_links, ("](",)),
    (M.flatten_dead_links, ("](#",)),
    (known_roles, ("<",)),
    (split_captions, ("**",)),
)


def _if_any(signs: tuple[str, ...], step):
    """``step`` for texts with one of the signs; others stay."""
    return lambda t: F.when(reduce(or_, [F.contains(t, F.lit(x)) for x in signs]), step(t)).otherwise(t)


def clean(text: Column) -> Column:
    """All built-in steps in order; HTML tables, which need a parser, come before (``markdown.html_tables_as_markdown``)."""
    for step, signs in STEPS:
        text = T.bound(text, _if_any(signs, step))
    return F.regexp_replace(text, "\\n{3,}", "\n\n")


def mark_superscripts(text: str, marks: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """Digits that were raised in print, marked after their words; each is looked for behind the one before. (text, marks not found)"""
    out, at, lost = [], 0, []
    for word, digits in marks:
        m = re.compile(rf"(?<!\w){re.escape(word)}{re.escape(digits)}(?!\d)").search(text, at)
        if not m:
            lost.append(word + digits)
            continue
        cut = m.end() - len(digits)
        out += [text[at:cut], f"^{digits}^"]
        at = m.end()
    return "".join(out) + text[at:], lost


def restore_tokens(text: str, parts: dict[str, str]) -> tuple[str, list[str]]:
    """Placeholders ``@@name@@`` replaced by what they stand for; (text, names that were lost on the way)."""
    seen = set()

    def one(m: re.Match) -> str:
        seen.add(m.group(1))
        return parts.get(m.group(1), m.group())

    text = re.sub(r"@@(\w+)@@", one, text)
    return text, sorted(set(parts) - seen)


def column_widths(cells: list[list[int]], total: int, least: int) -> list[int]:
    """Widths of columns in proportion to their longest cells, none under ``least``, together exactly ``total``."""
    n = max(map(len, cells), default=0)
    if not n:
        return []
    want = [max([1, *(row[c] for row in cells if c < len(row))]) for c in range(n)]
    least = min(least, total // n)
    fixed: set[int] = set()
    while True:
        free = [c for c in range(n) if c not in fixed]
        rest = total - least * len(fixed)
        whole = sum(want[c] for c in free)
        small = {c for c in free if want[c] * rest < least * whole}
        if not small or small == set(free):
            break
        fixed |= small
    widths = [least if c in fixed else want[c] * rest // whole for c in range(n)]
    widths[max(free, key=lambda c: want[c])] += total - sum(widths)
    return widths
