"""Checks of a target text against its source: what was lost, added, left or changed.

All checks of a pair run in one pass over Arrow batches in the scan's stage;
only differences of numbers go on, to be looked for next door.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import numbers as N
from quirework.functions import text as T
from quirework.operators import conservation as C
from quirework.operators import glossary as G
from quirework.session import ship

# Notes on a source that explain a difference; those of REASONED only with a reason after a colon.
STRUCTURE_NOTES = ("source_figure_reconstructed", "source_cover_rebuilt", "structure_reflowed")
NUMBER_NOTES = (*STRUCTURE_NOTES, "source_chart_", "source_figure_fragmented", "source_figure_only", "source_figure_image_fragmented", "source_figure_ocr_fragment", "source_figure_legend_fragmented")
UNTRANSLATED_NOTE = "untranslated_by_design"
REASONED = ("structure_reflowed", UNTRANSLATED_NOTE)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Texts whose sizes are less alike than this were reflowed.
REFLOWED = 0.65
#: How many items a message names.
NAMED = 6

# Signs of the formats and scripts that the checks count.
_STAMP = re.compile(r"[\w.-]+\.(?:qxd|indd)\s+\d+/\d+/\d+\s+\d+:\d\d\s+[AP]M(?:\s+Page\s+\S+)?", re.I)
_TAG, _IMAGE = re.compile(r"<[^>]+>"), re.compile(r"!\[[^\]]*\]\([^)]*\)")
_IMAGES = re.compile(r"(?:!\[[^\]]*\]\(|<img\b[^>]*\bsrc\s*=\s*[\"'])([^)\s\"']+)", re.I)
_CJK = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_URL = re.compile(r"https?://[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
_HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']", re.I)
_FORMULA = re.compile("[=∑∫√±≤≥×→]")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d{1,3}[.)])\s+", re.M)
_ENDS = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_UNIT = re.compile(rf"(?:{'|'.join(map(re.escape, [*N.UNITS, *N.LETTER_UNITS]))})$", re.I)
_DATE_EN, _DATE_ZH = re.compile(rf"\b(?:{MONTHS})\b\s+\d{{1,2}}", re.I), re.compile(r"\d{4}\s*年\s*\d{1,2}\s*月")


def weight(text: str) -> float:
    """Size in words, whatever the script; the same as ``text.prose_weight``."""
    ideographs = len(_CJK.findall(text))
    return len(_WORD.findall(_CJK.sub(" ", text) if ideographs else text)) + ideographs * T.CJK_WEIGHT


def comparison_text(text: str) -> str:
    """The words of a text, without printer's stamps, tags and images."""
    return _IMAGE.sub("", _TAG.sub("", _STAMP.sub("", text)))


def blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the blocks, which blank lines divide outside fences."""
    out: list[list[str]] = [[]]
    fence = ""
    for line in text.splitlines():
        mark = line.lstrip()[:3]
        if fence:
            out[-1].append(line)
            if mark == fence:
                fence = ""
                out.append([])
        elif mark in ("```", "~~~"):
            out.append([line])
            fence = mark
        elif line.strip():
            out[-1].append(line)
        else:
            out.append([])
    return [(_kind(x), "\n".join(x)) for x in out if any(map(str.strip, x))]


def _kind(lines: list[str]) -> str:
    if len(lines) == 1 and re.match(r"#{1,6}\s+\S", lines[0]):
        return "heading"
    if re.match(r"\s*(?:```|~~~)", lines[0]):
        return "code"
    if len(lines) > 1 and all("|" in x for x in lines):
        return "table"
    return "list" if re.match(r"\s*(?:[-*+] |\d+[.)]\s)", lines[0]) else "paragraph"


def urls(text: str) -> list[str]:
    """URLs without the punctuation of the sentence around them; brackets of their own stay."""
    out = []
    for url in _URL.findall(text):
        url = url.rstrip(".,;:!?'\"")
        for opening, closing in ("()", "[]"):
            while url.endswith(closing) and url.count(closing) > url.count(opening):
                url = url[:-1]
        out.append(url)
    return out


class Side:
    """What the checks compare, for one of two texts."""

    def __init__(self, raw: str) -> None:
        self.raw, self.text = raw, comparison_text(raw)
        parts = blocks(self.text)
        self.prose = [x for kind, x in parts if kind in ("paragraph", "list", "heading") and weight(x) > 0]
        self.cells = [c.strip() for kind, x in parts if kind == "table" for line in x.split("\n") for c in line.strip().strip("|").split("|") if weight(c) > 0]
        self.items = sum(len(_ITEM.findall(x)) for kind, x in parts if kind == "list")
        self.weight = sum(map(weight, [*self.prose, *self.cells]))
        self.size = weight(raw)
        lines = raw.splitlines()
        self.rows = sum(x.count("|") >= 2 for x in lines)
        self.fences = sum(x.lstrip().startswith(("```", "~~~")) for x in lines)
        self.formulas = sum(bool(_FORMULA.search(x)) for x in self.text.splitlines())
        self.images = Counter(_IMAGES.findall(raw))
        self.urls = Counter(urls(self.text) + urls(" ".join(_HREF.findall(raw))))
        self.numbers = Counter(N.canonical_tokens(self.text))
        self.units = Counter(m.group().lower() for x in self.numbers if (m := _UNIT.search(x)))

    def pieces(self) -> list[str]:
        sentences = [s for x in self.prose for s in _ENDS.split(x)]
        return list(dict.fromkeys(" ".join(x.split()) for x in [*sentences, *self.cells]))


def evidence(issues: list[str] | None, prefixes: tuple[str, ...]) -> bool:
    """Whether a note begins with one of the prefixes; a bare note that needs a reason is none."""
    return any(x.startswith(prefixes) and not (x.startswith(REASONED) and not x.partition(":")[2].strip()) for x in issues or () if x)


def _spelled(only: Counter, other: str) -> bool:
    """Whether every number is a small one that the other text writes in words."""
    low = other.casefold()

    def stands(form: str) -> bool:
        return bool(re.search(rf"(?<![a-z]){re.escape(form)}(?![a-z])", low)) if form.isascii() else form in other

    return all(re.fullmatch(r"\d{1,2}", x) and any(map(stands, N.SPELLINGS[int(x)])) for x in only)


def _named(bag: Counter) -> str:
    return ", ".join(f"{k}×{n}" for k, n in list(bag.items())[:NAMED]) or "none"


def examine(source: str, target: str, issues: list[str] | None = None) -> tuple[list[tuple[str, str, str]], Counter, Counter]:
    """(findings, numbers only the source has, numbers only the target has)."""
    s, t = Side(source), Side(target)
    lost, gained = s.numbers - t.numbers, t.numbers - s.numbers
    if not target.strip():
        return [("unit.output", "fail", "blank")] if source.strip() else [], lost, gained
    structural, numeric = evidence(issues, STRUCTURE_NOTES), evidence(issues, NUMBER_NOTES)
    out: list[tuple[str, str, str]] = []

    def check(name: str, status: str, detail: str) -> None:
        out.append((name, status, detail))

    if len(t.prose) != len(s.prose):
        check("content.block_coverage", "warn" if structural or len(t.prose) > len(s.prose) else "fail", f"{len(t.prose)} of {len(s.prose)} blocks")
    if t.items < s.items:
        check("content.block_coverage", "warn" if structural else "fail", f"{t.items} of {s.items} items")
    if s.weight >= C.LEAST_WEIGHT:
        ratio = t.weight / s.weight
        if ratio < C.FAIL_BELOW:
            check("content.length_ratio", "warn" if structural else "fail", f"{ratio:.0%}")
        elif ratio < C.WARN_BELOW or ratio > C.WARN_ABOVE:
            check("content.length_ratio", "warn", f"{ratio:.0%}")
    whole = " ".join(" ".join([*t.prose, *t.cells]).split())
    copied = [x for x in s.pieces() if weight(x) >= C.LEAST_PIECE and x in whole]
    if copied and t.weight:
        share = min(1.0, sum(map(weight, copied)) / t.weight)
        check("content.untranslated", "fail" if share >= C.COPIED_FAIL and not evidence(issues, (UNTRANSLATED_NOTE,)) else "warn", copied[0][:80])
    alike = min(s.size, t.size) / max(1.0, s.size, t.size)
    if s.rows != t.rows:
        check("structure.tables", "fail" if t.rows < s.rows and not numeric else "warn", f"{t.rows} of {s.rows} rows")
    if s.formulas != t.formulas:
        check("content.formulas", "warn" if numeric or alike < REFLOWED else "fail", f"{t.formulas} of {s.formulas} lines")
    if s.fences != t.fences:
        check("structure.code_fences", "fail", f"{t.fences} of {s.fences} fences")
    if s.images != t.images:
        check("assets.image_refs", "warn" if evidence(issues, STRUCTURE_NOTES[:2]) else "fail", _named(s.images - t.images))
    if s.urls != t.urls:
        check("content.urls", "fail", _named(s.urls - t.urls))
    if lost or gained:
        if _DATE_EN.search(source) and _DATE_ZH.search(target) or numeric or t.rows > s.rows and not lost:
            status = "warn"
        elif s.units and s.units == t.units:
            status = "fail"
        else:
            status = "warn" if alike < REFLOWED or _spelled(lost, target) and _spelled(gained, source) else "fail"
        check("content.numbers", status, f"source-only: {_named(lost)}; target-only: {_named(gained)}")
    return out, lost, gained


def bag_minus(a: Column, b: Column) -> Column:
    """Items of ``a`` beyond as many of the same in ``b``."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    return F.flatten(F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(F.lit(0), times(a, x) - times(b, x)))))


def heading_keys(text: Column) -> Column:
    """Numbers that headings begin with, and chapters of summaries, each once."""
    heads = F.transform(F.filter(T.lines(text), lambda x: x.rlike("^#{1,6}\\s+\\S")), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^#{1,6}\\s+", ""), "<[^>]+>", ""), "[*_`]", "")))
    number = lambda x: F.regexp_extract(x, "^([0-9]+(?:\\.[0-9]+)*)(?=[\\s\\x{3000}]|$)", 1)
    summary = lambda x: F.regexp_extract(x, "^\\x{7b2c}\\s*([0-9]+)\\s*\\x{7ae0}\\x{5185}\\x{5bb9}\\x{63d0}\\x{8981}", 1)
    keys = F.transform(heads, lambda x: F.when(number(x) != "", number(x)).when(summary(x) != "", F.concat(F.lit("summary:"), summary(x))))
    return F.sort_array(F.array_distinct(F.filter(keys, lambda x: x.isNotNull())))


def caption_keys(text: Column) -> Column:
    """Numbers of exhibits, figures and tables, each once; of Chinese captions where there are no others."""
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    latin = found("(?i)\\b(?:exhibit|figure|table)\\s*([0-9]+(?:[.][0-9]+)*[A-Z]?)")
    han = found("(?:\\x{56fe}\\x{8868}|\\x{56fe}|\\x{8868})\\s*([0-9]+(?:[.][0-9]+)*[A-Z]?)")
    return F.sort_array(F.when(F.size(latin) > 0, latin).otherwise(han))


def _item(what: str, side: str, x: Column) -> Column:
    return F.struct(F.lit(what).alias("what"), x.alias("item"), F.lit(side).alias("side"))


def key_difference(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Headings and captions that only one side has: ``key, what, item, side``."""
    rows = []
    for what, keys in (("heading", heading_keys), ("caption", caption_keys)):
        a, b = keys(F.col("source_text")), keys(F.col("target_text"))
        for side, only in (("source", F.array_except(a, b)), ("target", F.array_except(b, a))):
            rows.append(F.transform(only, partial(_item, what, side)))
    return pairs.select(*key, F.explode(F.concat(*rows)).alias("d")).select(*key, "d.what", "d.item", "d.side")


_FOUND = pa.list_(pa.struct([("check_id", pa.string()), ("status", pa.string()), ("detail", pa.string())]))


def _examined(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and, of each pair, ``found`` and the numbers that either side lacks."""
    issues = F.col("source_issues") if "source_issues" in pairs.columns else F.lit(None).cast("array<string>")
    rows = pairs.select(*keep, F.coalesce("source_text", F.lit("")).alias("_s"), F.coalesce("target_text", F.lit("")).alias("_t"), issues.alias("_issues"))
    kinds = rows.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "found array<struct<check_id:string,status:string,detail:string>>", "lost array<string>", "gained array<string>"])
    n = len(keep)

    def run(batches):
        for batch in batches:
            found, lost, gained = [], [], []
            for s, t, notes in zip(*(batch.column(n + i).to_pylist() for i in range(3)), strict=True):
                f, a, b = examine(s, t, notes)
                found.append([{"check_id": x, "status": y, "detail": z} for x, y, z in f])
                lost.append(list(a.elements()))
                gained.append(list(b.elements()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, _FOUND), pa.array(lost, pa.list_(pa.string())), pa.array(gained, pa.list_(pa.string()))], names=[*keep, "found", "lost", "gained"])

    ship(pairs.sparkSession)
    return rows.mapInArrow(run, schema)


def checks(pairs: DataFrame, group: list[str], order: str, key: list[str], glossary: DataFrame | None = None, node: str = "book_node_id") -> DataFrame:
    """``group, key, check_id, status, detail`` of every finding about pairs of texts.

    Needs ``source_text, target_text`` and, if there, ``source_issues``; null is
    an empty text. A failing difference of numbers is only a warning where what
    this target lacks is a surplus of the target before or after it, and what it
    has too many of is lacking there; neighbours are found by an equi-join on
    the position. With a glossary, its confirmed terms in scope are checked too.
    """
    rows = _examined(pairs, [*group, *key, order])
    out = rows.select(*group, *key, order, F.explode("found").alias("f"), "lost", "gained").select(*group, *key, order, "f.*", "lost", "gained")
    numbers = (F.col("check_id") == "content.numbers") & (F.col("status") == "fail")
    near = rows.where((F.size("lost") > 0) | (F.size("gained") > 0)).select(*group, F.explode(F.array(F.col(order) - 1, F.col(order) + 1)).alias(order), "lost", "gained")
    near = near.groupBy(*group, order).agg(F.flatten(F.collect_list("gained")).alias("near_gained"), F.flatten(F.collect_list("lost")).alias("near_lost"))  # two neighbours at most
    none = F.array().cast("array<string>")
    moved = (F.size(bag_minus(F.col("lost"), F.coalesce("near_gained", none))) == 0) & (F.size(bag_minus(F.col("gained"), F.coalesce("near_lost", none))) == 0)
    failing = out.where(numbers).join(near, [*group, order], "left").withColumn("status", F.when(moved, "warn").otherwise("fail"))
    names = [*group, *key, "check_id", "status", "detail"]
    all_ = out.where(~numbers).select(*names).unionByName(failing.select(*names))
    if glossary is None:
        return all_
    own = [f"_{k}" for k in key]  # an entry has an id of its own
    renamed = pairs.withColumnsRenamed(dict(zip(key, own, strict=True)))
    used = G.selected(renamed, glossary, [*group, *own], node, "source_text").join(glossary.where(F.col("target").isNotNull()).select("id", "source", "target"), "id").drop("id")
    terms = used.withColumnsRenamed(dict(zip(own, key, strict=True)))
    missing = terms.join(pairs.select(*group, *key, "target_text"), [*group, *key]).where((F.length(F.trim("target_text")) > 0) & ~G.target_present(F.col("target_text"), F.col("target")))
    return all_.unionByName(missing.select(*group, *key, F.lit("terminology.approved").alias("check_id"), F.lit("fail").alias("status"), F.concat_ws(" -> ", "source", "target").alias("detail")))
