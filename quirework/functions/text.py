"""Column functions over text: lines, signals, sizes, tokens, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes that sizes and tokens are counted with.
CJK = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}\\x{f900}-\\x{faff}]"
WORD = "[\\p{L}]+(?:['\\x{2019}][\\p{L}]+)*"
CJK_WEIGHT = 0.6
FORMULA_SIGNS = "[=\\x{2211}\\x{222b}\\x{221a}\\x{b1}\\x{2264}\\x{2265}\\x{d7}\\x{2192}]"
FORMULA = "\\$[^$]+\\$|\\\\\\[[\\s\\S]*?\\\\\\]"
HEADING = "^(#{1,6})\\s+(\\S.*?)\\s*$"
IMAGE = "(?i)(?:!\\[[^\\]]*\\]\\(|<img\\b[^>]*\\bsrc\\s*=\\s*[\"'])([^)\\s\"']+)"


def bound(text: Column, change) -> Column:
    """``change`` of a text that it names more than once; an expression would be worked out as often, this is once."""
    return F.get(F.transform(F.array(text), change), F.lit(0))


def lines(text: Column) -> Column:
    """Lines of a text; a final line end makes no further line, empty text has none."""
    body = F.regexp_replace(text, "\\n$", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def lines_where(text: Column, test) -> Column:
    return F.size(F.filter(lines(text), test))


def occurrences(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def table_signals(text: Column) -> Column:
    """Lines with two pipes or more."""
    return lines_where(text, lambda x: occurrences(x, "|") >= 2)


def code_fences(text: Column) -> Column:
    """Lines that open or close a fence."""
    return lines_where(text, lambda x: x.rlike("^\\s*(```|~~~)"))


def formula_signals(text: Column) -> Column:
    """Lines that look like an equation."""
    return lines_where(text, lambda x: x.rlike(FORMULA_SIGNS))


def formulas(text: Column) -> Column:
    return F.regexp_count(text, F.lit(FORMULA))


def heading_lines(text: Column) -> Column:
    return lines_where(text, lambda x: x.rlike(HEADING))


def images(text: Column) -> Column:
    """Targets of all images, Markdown's and HTML's."""
    return F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1))


def prose_weight(text: Column) -> Column:
    """Size in words, whatever the script: an ideograph counts as part of a word."""
    cjk = F.regexp_count(text, F.lit(CJK))
    words = F.regexp_count(F.regexp_replace(text, CJK, " "), F.lit(WORD))
    return words + cjk * F.lit(CJK_WEIGHT)


def is_markup_only(text: Column) -> Column:
    """No letter is left once tags and images are gone."""
    return ~F.regexp_replace(F.regexp_replace(text, "!\\[[^\\]]*\\]\\([^)]*\\)", ""), "<[^>]+>", "").rlike("\\p{L}")


def tokens(text: Column) -> Column:
    """Runs of two or more letters or digits, in small letters."""
    return F.transform(F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}]{2,}"), F.lit(0)), F.lower)


def plain(text: Column) -> Column:
    """Without spans, emphasis and outer marks, white space run together."""
    bare = F.regexp_replace(F.regexp_replace(text, "</?(?:span|div)\\b[^>]*>", ""), "[*_`]", "")
    return F.btrim(F.regexp_replace(bare, "\\s+", " "), F.lit(" #"))


def slug(text: Column, fallback: Column) -> Column:
    """A file-name-like key of at most 64 characters; ``book-`` and the first eight of the ``fallback`` hash if nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    return F.coalesce(F.nullif(F.substring(key, 1, 64), F.lit("")), F.concat(F.lit("book-"), F.substring(fallback, 1, 8)))


def display_width(text: Column) -> Column:
    """Columns on a fixed-pitch page: wide characters take two, combining marks none."""
    wide = F.regexp_count(text, F.lit("[\\x{1100}-\\x{115f}\\x{2e80}-\\x{303e}\\x{3041}-\\x{a4cf}\\x{ac00}-\\x{d7a3}\\x{f900}-\\x{faff}\\x{fe30}-\\x{fe4f}\\x{ff00}-\\x{ff60}\\x{ffe0}-\\x{ffe6}]"))
    return F.length(text) + wide - F.regexp_count(text, F.lit("\\p{Mn}"))


def identifier(heading: Column) -> Column:
    """The identifier a heading gets by itself; repeats are numbered by ``with_identifiers``."""
    kept = F.regexp_replace(F.lower(heading), "[^\\p{L}\\p{N}_.\\s-]", "")
    key = F.regexp_replace(F.regexp_replace(F.trim(kept), "\\s+", "-"), "^[^\\p{L}]+", "")
    return F.when(F.length(key) == 0, F.lit("section")).otherwise(key)


def normal_inventory(text: Column) -> Column:
    """Visible words only, for comparing editions: no links, images or tags, small letters."""
    bare = F.regexp_replace(F.regexp_replace(text, "!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), "<[^>]+>", "")
    return F.lower(F.regexp_replace(bare, "[^\\p{L}\\p{N}]", ""))


def caption_key(value: Column) -> Column:
    return F.upper(F.replace(value, F.lit("\u2013"), F.lit("-")))


def caption_class(label: Column) -> Column:
    name = F.lower(label)
    return F.when(name == "exhibit", "exhibit").when(name.isin("table", "\u8868"), "table").otherwise("figure")


def sentence_pieces(text: Column) -> Column:
    """Sentences as the coverage check compares them: distinct, in order, white space run together."""
    pieces = F.split(text, "(?<=[.!?\\x{2026}])\\s+|(?<=[\\x{3002}\\x{ff01}\\x{ff1f}])")
    return F.array_distinct(F.filter(F.transform(pieces, lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: F.length(x) > 0))


def urls(text: Column) -> Column:
    """URLs without the punctuation of the sentence around them; brackets of their own stay."""
    found = F.regexp_extract_all(text, F.lit("https?://[A-Za-z0-9._~:/?#\\[\\]@!$&'()*+,;=%-]+"), F.lit(0))

    def balanced(opening: str, closing: str):
        def cut(url: Column) -> Column:
            spare = F.greatest(F.lit(0), occurrences(url, closing) - occurrences(url, opening))
            tail = F.length(F.regexp_extract(url, f"\\{closing}*$", 0))
            return F.substring(url, F.lit(1), F.length(url) - F.least(spare, tail))

        return cut

    # one step a transform, so that no expression stands in another several times
    bare = F.transform(found, lambda x: F.regexp_replace(x, "[.,;:!?'\"]+$", ""))
    return F.transform(F.transform(bare, balanced("(", ")")), balanced("[", "]"))
