"""Problem 5: one consistent form for text that only looks the same.

An Arrow batch becomes one array of code points. Table gathers classify and
map every character of the batch at once, expansion offsets make room for
ligatures, marks are composed with their bases by a sorted pair table, and
words of mixed script are found by run boundaries. No call is made per row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.arrow import code_points, map_batches, row_counts, strings
from quirework.llm.encoding import repair_array

TOP = 0x110000
# Korean syllables are put together from these by the rule of the Unicode standard.
SYLLABLE, LEAD, VOWEL, FINAL, LEADS, VOWELS, FINALS = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28
LATIN, CYRILLIC, GREEK, OTHER = 1, 2, 3, 4

# Letters that look like a Latin letter (Unicode confusables, single letters only).
CYRILLIC_AS_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Һ": "h", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "ё": "ë", "ї": "ï", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ү": "y", "ӏ": "l", "Ӏ": "I", "ѵ": "v", "ԍ": "g", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n", "Ь": "b", "З": "3",
}
GREEK_AS_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w", "τ": "t", "ε": "e", "ϲ": "c", "ϳ": "j",
}
LATIN_AS_CYRILLIC = {
    "A": "А", "B": "В", "E": "Е", "S": "Ѕ", "I": "І", "J": "Ј", "K": "К", "M": "М", "H": "Н", "O": "О", "P": "Р", "C": "С", "T": "Т", "Y": "У", "X": "Х",
    "a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "y": "у", "x": "х", "s": "ѕ", "i": "і", "j": "ј", "k": "к", "m": "м", "t": "т", "u": "и", "n": "п", "r": "г", "b": "в", "h": "н", "ë": "ё",
}
LATIN_AS_GREEK = {v: k for k, v in GREEK_AS_LATIN.items()}

SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2043\ufe63\uff0d"
INVISIBLE = "\u00ad\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"


def _kept(c: str) -> bool:
    """Compatibility characters that are no variant of a plain letter, digit or ideograph."""
    if "\u2e80" <= c <= "\u2fd5":  # radicals in place of ideographs
        return False
    if unicodedata.category(c)[0] not in "LN":
        return True
    tag = unicodedata.decomposition(c).split(" ")[0]
    return tag in ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>", "<small>", "<compat>") and "LIGATURE" not in unicodedata.name(c, "")


class Tables:
    """Lookup tables over all code points, made by rule from the Unicode database."""

    def __init__(self) -> None:
        self.single = np.arange(TOP, dtype=np.uint32)  # what a character becomes
        self.width = np.ones(TOP, np.uint8)  # how many characters it becomes
        self.variant = np.zeros(TOP, bool)  # a look-alike by itself
        self.script = np.zeros(TOP, np.uint8)
        self.joins = np.zeros(TOP, bool)  # part of a word though no letter
        self.mark = np.zeros(TOP, bool)
        self.pictograph = np.zeros(TOP, bool)
        self.shaping = np.zeros(TOP, bool)  # scripts in which joiners shape the text
        self.expanded: dict[int, np.ndarray] = {}
        pairs = []
        for p in range(0x80, 0x32000):
            if 0xD800 <= p < 0xE000 or 0x3400 <= p < 0xA000 or 0xAC00 <= p < 0xD7B0:
                continue
            c = chr(p)
            category = unicodedata.category(c)
            if category == "Cn":
                continue
            self.mark[p] = category == "Mn" and 0x300 <= p < 0x370
            plain = unicodedata.decomposition(c)
            if plain and plain[0] != "<" and " " in plain and unicodedata.normalize("NFC", c) == c:
                a, b = (int(x, 16) for x in plain.split(" "))
                pairs.append((a, b, p))
            form = unicodedata.normalize("NFKC", c)
            if form != c and category[0] in "LNS" and not _kept(c) and not self.mark[p] and (plain[:1] == "<" or unicodedata.normalize("NFC", c) != c):
                self.variant[p] = True
                self.width[p] = len(form)
                if len(form) == 1:
                    self.single[p] = ord(form)
                else:
                    self.expanded[p] = np.array([ord(x) for x in form], np.uint32)
        # Radicals that the database leaves without a decomposition stay as they are.
        for c in SPACES:
            self.single[ord(c)], self.variant[ord(c)], self.width[ord(c)] = 0x20, True, 1
            self.expanded.pop(ord(c), None)
        for c in HYPHENS:
            self.single[ord(c)], self.variant[ord(c)], self.width[ord(c)] = 0x2D, True, 1
        self.invisible = np.zeros(TOP, bool)
        self.invisible[[ord(c) for c in INVISIBLE]] = True
        self.invisible[0xFE00:0xFE10] = True
        self.invisible[0xE0100:0xE01F0] = True
        self.script[0x41:0x5B] = self.script[0x61:0x7B] = LATIN
        self.script[0xC0:0x250] = LATIN
        self.script[0x1E00:0x1F00] = LATIN
        self.script[[0xD7, 0xF7]] = 0
        self.script[0x370:0x400] = self.script[0x1F00:0x2000] = GREEK
        self.script[0x400:0x530] = CYRILLIC
        for low, high in ((0x530, 0x1E00), (0x2C00, 0x2E00), (0x3040, 0xD7B0), (0xF900, 0xFB00), (0x20000, 0x32000)):
            self.script[low:high] = OTHER
        self.shaping[0x600:0x1100] = True
        self.shaping[0x1780:0x1880] = True
        self.pictograph[0x1F000:0x1FB00] = self.pictograph[0x2600:0x27C0] = self.pictograph[0x2190:0x2400] = True
        self.pictograph[0xFE0F] = True
        pairs.sort()
        self.pair_key = np.array([(a << 32) | b for a, b, _ in pairs], np.uint64)
        self.pair_to = np.array([p for _, _, p in pairs], np.uint32)
        self.rank = np.zeros(TOP, np.uint8)  # canonical combining class
        self.second = np.zeros(TOP, bool)  # may join with, or move before, what stands before it
        self.parts_width = np.zeros(TOP, np.uint8)  # how many letters and marks a character is made of, 0 for itself
        self.parts: dict[int, np.ndarray] = {}
        for p in range(0x80, 0x32000):
            if 0xD800 <= p < 0xE000 or 0x3400 <= p < 0xA000 or 0xAC00 <= p < 0xD7B0:
                continue
            self.rank[p] = unicodedata.combining(chr(p))
            apart = unicodedata.normalize("NFD", chr(p))
            if apart != chr(p):
                self.parts_width[p] = len(apart)
                self.parts[p] = np.array([ord(x) for x in apart], np.uint32)
        self.second |= self.rank > 0
        self.second[[b for _, b, _ in pairs]] = True
        self.second[VOWEL : VOWEL + VOWELS] = self.second[FINAL + 1 : FINAL + FINALS] = True
        self.look = {}
        for to, frm, names in ((LATIN, CYRILLIC, CYRILLIC_AS_LATIN), (LATIN, GREEK, GREEK_AS_LATIN), (CYRILLIC, LATIN, LATIN_AS_CYRILLIC), (GREEK, LATIN, LATIN_AS_GREEK)):
            gather = np.zeros(0x2000, np.uint32)
            for a, b in names.items():
                gather[ord(a)] = ord(b)
            self.look[to, frm] = gather


    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair of characters is as one, 0 where it is none."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b
        i = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        out = np.where(self.pair_key[i] == key, self.pair_to[i], 0).astype(np.int64)
        a, b = a.astype(np.int64), b.astype(np.int64)
        lead, vowel, final, whole = a - LEAD, b - VOWEL, b - FINAL, a - SYLLABLE
        open_ = (lead >= 0) & (lead < LEADS) & (vowel >= 0) & (vowel < VOWELS)
        closed = (whole >= 0) & (whole < LEADS * VOWELS * FINALS) & (whole % FINALS == 0) & (final > 0) & (final < FINALS)
        return np.where(open_, SYLLABLE + (lead * VOWELS + vowel) * FINALS, np.where(closed, a + final, out))


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _expand(points: np.ndarray, offsets: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Map every character; those that become several move the rest along."""
    width = t.width[points]
    if (width == 1).all():
        return t.single[points], offsets
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    out = np.repeat(t.single[points], width)
    for p in np.unique(points[width > 1]):
        where = at[:-1][points == p]
        for k, value in enumerate(t.expanded[int(p)]):
            out[where + k] = value
    return out, at[offsets]


def _remove(points: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = np.zeros(len(points) + 1, np.int64)
    np.cumsum(~gone, out=kept[1:])
    return points[~gone], kept[offsets]


def _compose(points: np.ndarray, offsets: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bring every base and the marks after it into canonical composition; rows stay apart. Also counts what changed by row.

    Bases with marks are taken apart, the marks put into canonical order and
    joined again, the n-th mark of all of them in one step.
    """
    counts = np.zeros(len(offsets) - 1, np.int64)
    second = t.second[points]
    second[offsets[:-1][offsets[:-1] < len(points)]] = False  # a mark that begins a row has no base
    if not second.any():
        return points, offsets, counts
    base = np.zeros(len(points), bool)
    base[:-1] = second[1:] & ~second[:-1]
    member = np.flatnonzero(second | base)
    base_at = np.flatnonzero(base)
    before = points[member]
    run = np.cumsum(base[member]) - 1
    width = t.parts_width[before].astype(np.int64)
    if (width > 0).any():
        apart, width = width > 0, np.maximum(width, 1)
        sub, at = np.repeat(before, width), np.cumsum(width) - width
        for p in np.unique(before[apart]):
            where = at[before == p]
            for k, value in enumerate(t.parts[int(p)]):
                sub[where + k] = value
        run = np.repeat(run, width)
    else:
        sub = before.copy()
    rank = t.rank[sub]
    order = np.lexsort((rank, np.cumsum((rank == 0) | np.append(True, run[1:] != run[:-1]))))  # marks of one starter by class, those of a class as they stand
    sub, rank = sub[order], rank[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    place = np.arange(len(sub)) - first[run]
    by_place = np.argsort(place, kind="stable")
    steps = np.searchsorted(place[by_place], np.arange(1, place.max() + 2))
    starter, last = first.copy(), np.full(len(first), -1)  # -1: nothing stands between the starter and what comes
    gone = np.zeros(len(sub), bool)
    for x, y in zip(steps[:-1], steps[1:], strict=True):
        e = by_place[x:y]
        r, c = run[e], rank[e]
        to = t.pair(sub[starter[r]], sub[e])
        hit = (to > 0) & ((last[r] == -1) | (c > 0) & (last[r] < c))
        sub[starter[r][hit]] = to[hit]
        gone[e[hit]] = True
        r, c, e = r[~hit], c[~hit], e[~hit]
        last[r] = np.where(c == 0, -1, c)
        starter[r[c == 0]] = e[c == 0]
    kept, run = sub[~gone], run[~gone]
    size = np.bincount(run, minlength=len(first))
    width = np.ones(len(points), np.int64)
    width[member] = 0
    width[base_at] = size
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    out = np.repeat(points, width)
    into = ends[base_at][run] + np.arange(len(run)) - np.searchsorted(run, np.arange(len(first)))[run]
    out[into] = kept
    had = np.bincount(np.cumsum(base[member]) - 1, minlength=len(first))
    changed = had != size
    same = np.flatnonzero(~changed)
    if len(same):
        inside = np.isin(run, same)
        differs = np.zeros(len(first), bool)
        np.logical_or.at(differs, run[inside], kept[inside] != before[np.isin(np.cumsum(base[member]) - 1, same)])
        changed |= differs
    flags = np.zeros(len(points), bool)
    flags[base_at[changed]] = True
    return out, ends[offsets], row_counts(flags, offsets)


def _words(points: np.ndarray, offsets: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace letters of another script in words of mixed script. (points, replaced, rows' counts)"""
    script = t.script[points]
    changed = np.zeros(len(points), bool)
    if not ((script == CYRILLIC) | (script == GREEK)).any():
        return points, changed, np.zeros(len(offsets) - 1, np.int64)
    edge = np.zeros(len(points) + 1, bool)
    inside = (script > 0) & (script < OTHER) | t.mark[points]
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1])
    starts = starts[inside[starts]]
    if not len(starts):
        return points, changed, np.zeros(len(offsets) - 1, np.int64)
    stops = np.flatnonzero(edge)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    number = [np.concatenate(([0], np.cumsum(script == s))) for s in (LATIN, CYRILLIC, GREEK)]
    n = np.stack([x[ends] - x[starts] for x in number])  # script x word
    row = np.searchsorted(offsets, starts, side="right") - 1
    of_row = np.stack([x[offsets[1:]] - x[offsets[:-1]] for x in number])[:, row]
    mixed = (n > 0).sum(0) > 1
    for w in np.flatnonzero(mixed):
        a, b = int(starts[w]), int(ends[w])
        word, own = points[a:b], script[a:b]
        present = [s for s in (LATIN, CYRILLIC, GREEK) if n[s - 1, w]]
        # the word's own script: one into which all its other letters map, the row's usual script first
        for home in sorted(present, key=lambda s: (-of_row[s - 1, w], -n[s - 1, w])):
            to = word.copy()
            for s in present:
                if s == home:
                    continue
                gather = t.look.get((home, s))
                letters = own == s
                mapped = gather[np.minimum(word[letters], 0x1FFF)] if gather is not None else np.zeros(letters.sum(), np.uint32)
                if not len(mapped) or (mapped == 0).any():
                    break
                to[letters] = mapped
            else:
                if points.flags.writeable is False:
                    points = points.copy()
                changed[a:b] = to != word
                points[a:b] = to
                break
    return points, changed, row_counts(changed, offsets)


def normalise(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts in one form, and how many look-alikes each held."""
    t = tables()
    points, offsets = code_points(array)
    found = row_counts(t.variant[points], offsets)
    hidden = t.invisible[points]
    if hidden.any():
        at = np.flatnonzero(hidden)
        before = np.where(at > 0, points[np.maximum(at - 1, 0)], 0)
        after = np.where(at + 1 < len(points), points[np.minimum(at + 1, len(points) - 1)], 0)
        joiner = (points[at] == 0x200D) | (points[at] == 0x200C)
        shaped = (points[at] >= 0xFE00) & (points[at] <= 0xFE0F) & (t.pictograph[before] | (before < 0x40))
        shaped |= (points[at] == 0x200D) & t.pictograph[before] & t.pictograph[after]
        shaped |= joiner & t.shaping[before] & (t.shaping[after] | (after == 0))
        hidden[at[shaped]] = False
        found = found + row_counts(hidden, offsets)
        points, offsets = _remove(points, offsets, hidden)
    points, offsets = _expand(points, offsets, t)
    points, offsets, joined = _compose(points, offsets, t)
    # a mark without a composed form still stands apart from its letter
    loose = t.mark[points]
    points, _, replaced = _words(points, offsets, t)
    found = found + joined + row_counts(loose, offsets) + replaced
    if loose.any() and replaced.any():  # a mark may fit the letter that took its base's place
        points, offsets, _ = _compose(points, offsets, t)
    return strings(points, offsets), found


NORMAL = "book_id string, id string, text string, title string, n_found int"
FOUND = "book_id string, id string, n_found int"


def normalise_segments(segments: DataFrame) -> DataFrame:
    """``text`` and ``title`` of every segment in one form, with the number of look-alikes found in ``text``.

    Needs ``book_id, id, text, title``; other columns are ignored. Null stays
    null and counts 0; empty text stays empty; a row delivered twice gives equal
    rows. Legitimate letters of other scripts, full-width punctuation,
    typographic quotes and dashes, superscripts and symbols stay. There is no
    shuffle.
    """
    rows = segments.select(F.col("book_id").cast("string"), F.col("id").cast("string"), F.col("text").cast("string"), F.col("title").cast("string"))

    def run(batch: pa.RecordBatch) -> dict:
        out = {"book_id": batch.column("book_id"), "id": batch.column("id")}
        for name in ("text", "title"):
            column = batch.column(name)
            new, found = normalise(column)
            out[name] = pc.if_else(column.is_null(), None, new)
            if name == "text":
                out["n_found"] = pa.array(found, pa.int32())
        return out

    return map_batches(rows, ["book_id", "id", "text", "title"], run, NORMAL)


def find_lookalikes(segments: DataFrame) -> DataFrame:
    """Segments whose ``text`` holds a look-alike and was not decoded with a wrong encoding.

    A look-alike is never ASCII, so plain rows are dropped in the scan's stage;
    the decoding test runs on the few rows found. Null text is no case.
    """
    rows = segments.select(F.col("book_id").cast("string"), F.col("id").cast("string"), F.col("text").cast("string")).where(F.octet_length("text") > F.char_length("text"))

    def run(batch: pa.RecordBatch) -> dict:
        _, found = normalise(batch.column("text"))
        at = np.flatnonzero(found)
        texts = batch.column("text").take(pa.array(at))
        _, wrong = repair_array(texts)
        at = at[~wrong]
        rows = pa.array(at)
        return {"book_id": batch.column("book_id").take(rows), "id": batch.column("id").take(rows), "n_found": pa.array(found[at], pa.int32())}

    return map_batches(rows, ["book_id", "id", "text"], run, FOUND)
