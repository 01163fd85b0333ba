"""Problem 4: sentences of a book and its edition in another language.

A target sentence is an emission of a source state of a hidden Markov model:
one sentence, a span of neighbouring sentences (merges) or null (additions).
Jump probabilities favour going on to the next sentence and allow staying
(divided sentences), short moves either way and, at a price, far ones. Words
are emitted by a lexicon trained here on all confirmed paragraphs (IBM model 1,
expectation maximisation, block by block of the target's words); numbers and
names emit themselves.

Where in the source a target segment belongs is told by anchors: numbers, names
and words of the lexicon, and pairs of them, that are rare on both sides.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.llm.arrow import map_batches, map_groups
from quirework.llm.encoding import repair_array
from quirework.llm.lookalike import normalise
from quirework.session import cut, ship

ROUNDS = 5
#: Pairs of words that a task of the fit holds, about, and those that one step weighs.
FITTED, WEIGHED = 1 << 20, 1 << 20
#: Expected counts are multiples of this, so that their sums are the same in any order.
GRAIN = 2.0**-30
#: Less likely translations are not kept.
LEAST_LIKELY = 2e-3
#: Segments of the source in a block, and segments beyond its ends that a block also sees.
BLOCK, MARGIN = 64, 24
NULL_COST, SPAN_COST = -4.0, (0.0, -1.5, -3.5)
STAY, NEXT, STEP, FAR = -2.0, -0.2, -0.9, -7.0
#: Moves further than this from the next position cost as much as any far one.
REACHED = 7
#: A pair must explain each word of the target better than chance by so much, in nats.
LEAST_GAIN = 0.5
#: Each sentence of a merge must add so much to what the others explain.
MEMBER_GAIN = 3.0
#: Segments either way whose anchors help to place one, width of a place in segments, what the anchors of a place and of one segment must weigh, and what one pair of segments may weigh.
REACH, PLACE, LEAST_VOTES, OWN_VOTES, MOST_VOTES = 16, 16, 2.0, 1.0, 3.0
#: A pair found away from a segment's home must explain so much more than the one at home.
AWAY_COST = 1.0

_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:No|Nr|Nos|Abb|Fig|Kap|Bd|Vol|Art|Ch|p|pp|S|Tab|núm|n)\.$", re.I)
_END = re.compile(r"[.!?](?=\s|$)|[。！？]")


def sentences(text: str) -> list[str]:
    """Sentences of a segment in order."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m.group() == "." and _ABBREVIATION.search(text[max(start, m.start() - 6) : m.end()]) and re.match(r"\s*\d", text[m.end() : m.end() + 4]):
            continue
        part = text[start : m.end()].strip()
        if part:
            out.append(part)
        start = m.end()
    rest = text[start:].strip()
    return [*out, rest] if rest else out


_TOKEN = re.compile(r"\d+(?:[.,]\d+)*(?:\s?[万亿])?月?|[㐀-鿿]+|[^\W\d_]+")


def tokens(sentence: str) -> list[str]:
    """Words in small letters, pairs of ideographs, numbers by value as ``#n``."""
    out = []
    for m in _TOKEN.finditer(unicodedata.normalize("NFKC", sentence)):
        t = m.group()
        if t[0].isdigit():
            out.append(t if t.endswith("月") else number(t))
        elif "㐀" <= t[0] <= "鿿":
            out += [t[i : i + 2] for i in range(len(t) - 1)] or [t]
        else:
            out.append(t.lower())
    return out


def number(text: str) -> str:
    """A number by value, whatever its separators: 18,000, 18.000 and 1.8万 are ``#18000``."""
    factor = 10_000 if text.endswith("万") else 100_000_000 if text.endswith("亿") else 1
    body = text.rstrip("万亿 ")
    if factor == 1 and re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+", body):
        body = re.sub(r"[.,]", "", body)
    body = body.replace(",", ".")
    try:
        value = float(body) * factor
    except ValueError:
        return "#" + body
    return f"#{value:g}" if value != int(value) else f"#{int(value)}"


class Lexicon:
    """Translation probabilities t(target | source), and how likely a target word is anyway."""

    def __init__(self, seen: dict[str, int], total: dict[str, int], s: np.ndarray, t: np.ndarray, p: np.ndarray) -> None:
        """``seen``: pairs that hold a source word, the empty word (null) in all; ``total``: how often a target word occurs; ``s, t``: places in these."""
        self.words = list(seen)
        self.source = {w: i for i, w in enumerate(seen)}
        self.target = {w: i for i, w in enumerate(total)}
        self.size = seen.get("", 0)
        self.seen: Counter[str] = Counter({w: n for w, n in seen.items() if w})
        self.usual = np.fromiter(total.values(), float, len(total)) / max(1, sum(total.values()))
        order = np.lexsort((s, t))
        self.of, self.p = s[order], p[order]
        self.starts = np.searchsorted(t[order], np.arange(len(total) + 1))
        self.found: dict[str, list[str]] = {}

    def source_words(self, word: str) -> list[str]:
        """At most two words that a target word most often renders."""
        if word not in self.found:
            k = self.target.get(word)
            own = slice(0, 0) if k is None else slice(*self.starts[k : k + 2])
            ranked = sorted(((v * self.seen[self.words[a]], self.words[a]) for a, v in zip(self.of[own].tolist(), self.p[own].tolist(), strict=True) if self.words[a]), reverse=True)
            self.found[word] = [x for v, x in ranked[:2] if v >= 0.5 * ranked[0][0]]
        return self.found[word]

    def matrix(self, source: list[str], target: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(t by target and source word, t by null, usual probability, whether anything is known) for the words given."""
        ids = np.array([self.source.get(w, -1) for w in source], np.int64)
        of_target = np.array([self.target.get(w, -1) for w in target], np.int64)
        t = np.zeros((len(target), len(source)))
        null, usual = np.zeros(len(target)), np.full(len(target), 1e-3)
        known = np.ones(len(target))
        stated = np.flatnonzero(of_target >= 0)
        own = of_target[stated]
        usual[stated] = np.maximum(self.usual[own], 1e-5)
        at, n = _ranges(self.starts[own], self.starts[own + 1])
        row, of, p = np.repeat(stated, n), self.of[at], self.p[at]
        null[row[of == 0]] = p[of == 0]
        order = np.argsort(ids, kind="stable")
        place = order[np.minimum(np.searchsorted(ids, of, sorter=order), len(ids) - 1)]
        here = ids[place] == of
        t[row[here], place[here]] = p[here]
        same = {w: i for i, w in enumerate(source)}
        for j, w in enumerate(target):
            if w[0] == "#":
                usual[j] = 2e-4
            if w in same and (w[0] == "#" or len(w) >= 4 and w.isascii()):
                t[j, same[w]] = max(t[j, same[w]], 0.9 if w[0] == "#" else 0.5)
            elif of_target[j] < 0 and w[0] != "#":
                known[j] = 0.0  # says nothing for or against any source
        return t, null, usual, known


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each first one to before its end, one range after another, and how many each has."""
    n = end - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n), n


def align(source: list[list[str]], target: list[list[str]], lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """(source, target, gain) of the best path; a merge gives a row for each sentence of its span."""
    if not source or not target:
        return []
    n, m = len(source), len(target)
    s_words = sorted({w for x in source for w in x})
    t_words = sorted({w for x in target for w in x})
    if not s_words or not t_words:
        return []
    s_at = {w: i for i, w in enumerate(s_words)}
    t_at = {w: i for i, w in enumerate(t_words)}
    t, null, usual, known = lexicon.matrix(s_words, t_words)
    of_source = _sums(t.T, [[s_at[w] for w in x] for x in source]).T  # target word x source sentence
    s_size = np.array([len(x) for x in source])
    in_target = [[k for w in x if known[k := t_at[w]]] for x in target]  # the others say nothing
    least = np.maximum(2.0, LEAST_GAIN * _sums(known[:, None], in_target)[:, 0])
    floor = np.where(np.array([w[0] == "#" for w in t_words]), 0.05, 0.2)
    numbers = [w for w in s_words if w[0] == "#"]
    place = {w: k for k, w in enumerate(numbers)}
    has_number = np.zeros((len(numbers), n), bool)  # source number x sentence
    number_t = np.zeros((m, len(numbers)))
    for i, x in enumerate(source):
        for w in x:
            if w in place:
                has_number[place[w], i] = True
    for j, x in enumerate(target):
        for w in x:
            if w in place:
                number_t[j, place[w]] = 1
    gains = []
    for span in (1, 2, 3):
        if n < span:
            break
        together = lambda x, span=span: sum(x[..., k : n - span + 1 + k] for k in range(span))
        p = 0.1 * null[:, None] + 0.9 * (together(of_source) / np.maximum(together(s_size), 1))
        gain = _sums(np.log(np.maximum(p / usual[:, None], floor[:, None])), in_target)
        if len(numbers):
            gain -= 1.5 * ((1 - number_t) @ (together(has_number.astype(np.int8)) > 0))
        gains.append(gain)  # target x start
    # from position p-1 to start: near ones each at a price, all others at that of a far jump
    moves = np.arange(REACHED, -REACHED - 1, -1)  # distance less one, the earliest position first
    prices = np.where(moves == 0, NEXT, np.where(moves == -1, STAY, np.maximum(FAR, STEP * np.abs(moves) - 0.5)))
    around = np.full(n + 1 + 2 * REACHED, -math.inf)
    near = sliding_window_view(around, 2 * REACHED + 1)[:n]
    values = np.full((m + 1, n + 1), -math.inf)  # index p+1: the last source sentence used was p
    values[0, 0] = 0.0
    priced = [g + cost for g, cost in zip(gains, SPAN_COST, strict=False)]
    for j in range(m):
        before, best = values[j], values[j + 1]
        around[REACHED : REACHED + n + 1] = before
        enter = np.maximum((near + prices).max(1), before.max() + FAR)
        np.add(before, NULL_COST, out=best)
        for span, gain in enumerate(priced, 1):
            np.maximum(best[span:], enter[: n - span + 1] + gain[j], out=best[span:])
    out = []
    at = int(values[m].argmax())
    for j in range(m - 1, -1, -1):
        # how the best came about is worked out again, but only along the path
        before = values[j]
        around[REACHED : REACHED + n + 1] = before
        far = int(before.argmax())
        score, frm, span = before[at] + NULL_COST, at, 0
        for k, gain in enumerate(priced, 1):
            if at >= k:
                window = near[at - k] + prices
                step = int(window.argmax())
                enter, came = window[step], at - k + step - REACHED
                if before[far] + FAR > enter:
                    enter, came = before[far] + FAR, far
                if enter + gain[j, at - k] > score:
                    score, frm, span = enter + gain[j, at - k], came, k
        if span:
            start = at - span
            gain = float(gains[span - 1][j, start])
            if gain >= least[j]:
                out += [(i, j, gain) for i in _members(gains, j, start, span) if _numbers_agree(source[i], target[j])]
        at = frm
    return out[::-1]


def _sums(rows: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The sum of the rows that each group names, a row a group; the k-th members of all groups are added in one step."""
    out = np.zeros((len(groups), rows.shape[1]))
    order = sorted(range(len(groups)), key=lambda g: -len(groups[g]))
    for k in range(len(groups[order[0]]) if order else 0):
        having = [g for g in order if len(groups[g]) > k]
        out[having] += rows[[groups[g][k] for g in having]]
    return out


def _members(gains: list[np.ndarray], j: int, start: int, span: int) -> range:
    """The sentences of a span without ends that explain nothing of the target."""
    end = start + span
    while end - start > 1:
        whole, shorter = gains[end - start - 1][j, start], gains[end - start - 2]
        without_first, without_last = whole - shorter[j, start + 1], whole - shorter[j, start]
        if min(without_first, without_last) >= MEMBER_GAIN:
            break
        if without_first < without_last:
            start += 1
        else:
            end -= 1
    return range(start, end)


def _numbers_agree(a: list[str], b: list[str]) -> bool:
    """Sentences that both name numbers share one if they render each other."""
    of_a, of_b = {w for w in a if w[0] == "#"}, {w for w in b if w[0] == "#"}
    return not of_a or not of_b or bool(of_a & of_b)


#: ``sentences`` are the words of each sentence, joined by a separator; ``han`` says which are in ideographs.
SENTENCES = "book_id string, id string, ord int, sentences array<string>, han array<boolean>"
_SEP = "\x1f"
_HAN = re.compile("[一-鿿]{3}")


def _split(batch: pa.RecordBatch) -> dict:
    texts, _ = repair_array(batch.column("text"))
    texts, _ = normalise(texts)
    parts = [sentences(text) for text in texts.to_pylist()]
    words = pa.array([[_SEP.join(tokens(x)) for x in p] for p in parts], pa.list_(pa.string()))
    han = pa.array([[bool(_HAN.search(x)) for x in p] for p in parts], pa.list_(pa.bool_()))
    return {"book_id": batch.column("book_id"), "id": batch.column("id"), "ord": batch.column("ord"), "sentences": words, "han": han}


def _words(sentence: str) -> list[str]:
    return sentence.split(_SEP) if sentence else []


ANCHORS = "book_id string, side string, ord int, anchor bigint"


@lru_cache(1 << 16)
def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def anchors(sentence: list[str], lexicon: Lexicon, translated: bool, seen: Counter[str], size: int) -> set[int]:
    """Hashes of what may tell a sentence's place: numbers, names and words in the source's language, and pairs of them."""
    words: set[str] = set()
    for w in sentence:
        if w[0] == "#" or not translated:
            words.add(w)
        else:
            words.update(lexicon.source_words(w))
        if translated and len(w) >= 4 and w.isascii():
            words.add(w)
    numbers = [w for w in words if w[0] == "#"]
    usual = max(3.0, 0.1 * size)
    rest = sorted((w for w in words if w[0] != "#" and len(w) > 1 and seen[w] <= usual), key=lambda w: (seen[w] == 0, seen[w], w))[:12]
    out = {_hash(w) for w in (*numbers, *rest)}
    pairs = [(x, y) for i, x in enumerate(numbers) for y in (*numbers[i + 1 :], *rest)] + [(x, y) for i, x in enumerate(rest[:5]) for y in rest[i + 1 : 5]]
    out |= {(_hash(x) ^ _hash(y)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for x, y in pairs}
    return {(h & 0x7FFFFFFFFFFFFFFF) for h in out}


def _anchors(lexicons: dict[bool, Lexicon]):
    seen, size = lexicons[False].seen + lexicons[True].seen, lexicons[False].size + lexicons[True].size

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("book_id", "side", "ord", "anchor")}
        for book, side, order, han, parts in zip(*(batch.column(n).to_pylist() for n in ("book_id", "side", "ord", "han", "sentences")), strict=True):
            found: set[int] = set()
            for sentence in parts:
                found |= anchors(_words(sentence), lexicons[han], side == "b", seen, size)
            for column, value in zip(out.values(), (book, side, order), strict=False):
                column += [value] * len(found)
            out["anchor"] += found
        return {k: pa.array(v, {"ord": pa.int32(), "anchor": pa.int64()}.get(k, pa.string())) for k, v in out.items()}

    return run


PLACES = "book_a string, book_b string, ord int, at double, home boolean"


def places(ord_a: np.ndarray, ord_b: np.ndarray, weight: np.ndarray, first: int, n: int) -> list[tuple[int, float, bool]]:
    """(target order, source position, whether its home) for ``n`` orders from ``first`` on; the pairs, by target order, vouch for their neighbours."""
    out: list[tuple[int, float, bool]] = []
    homes: dict[int, float] = {}
    for j in range(first, first + n):
        near = slice(*np.searchsorted(ord_b, (j - REACH, j + REACH + 1)))
        if near.start == near.stop:
            continue
        at = ord_a[near] + (j - ord_b[near])
        w = weight[near] * (1 - np.abs(ord_b[near] - j) / (REACH + 1))
        bins, place = np.unique(np.floor_divide(at, PLACE), return_inverse=True)
        mass, moment = np.bincount(place, w), np.bincount(place, w * at)
        step = np.diff(bins) == 1
        total, mean = mass.copy(), moment.copy()
        for x, y in ((total, mass), (mean, moment)):
            x[1:][step] += y[:-1][step]
            x[:-1][step] += y[1:][step]
        top = np.ones(len(bins), bool)
        top[1:][step] &= mass[1:][step] >= mass[:-1][step]
        top[:-1][step] &= mass[:-1][step] > mass[1:][step]
        good = np.flatnonzero(top & (total >= LEAST_VOTES))
        own = slice(*np.searchsorted(ord_b, (j, j + 1)))
        own_at = [float(x) for x, v in zip(ord_a[own], weight[own], strict=True) if v >= OWN_VOTES]
        spots = [float(mean[k] / total[k]) for k in good[np.argsort(-total[good], kind="stable")]]
        if spots:
            homes[j] = spots[0]
        for at_ in dict.fromkeys((*spots[1:], *own_at)):
            out.append((j, at_, False))
    if homes:
        placed = np.array(sorted(homes))
        for j in range(first, first + n):
            k = int(placed[np.abs(placed - j).argmin()])
            out.append((j, homes[k] + j - k, True))
    return out


PAIRS = "book_a string, id_a string, sent_a int, book_b string, id_b string, sent_b int, gain double"


#: Words of a confirmed pair: those of the source, with the empty one for null, and those of the target with their counts.
BAGS = "han boolean, s array<string>, t array<string>, n array<bigint>"
#: Rows of a block of target words: what was expected of pairs of words (part 0), and a paragraph's words (part 1; v: counts of t).
FIT = "block int, part int, s array<int>, t array<int>, v array<double>"
_FIT = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("s", pa.list_(pa.int32())), ("t", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))])


def train(alignment: DataFrame, glossary: DataFrame | None = None) -> dict[bool, Lexicon]:
    """A lexicon for targets in ideographs and one for others, of all confirmed paragraphs and all terms of a glossary, each a pair.

    The target's words are dealt out to blocks, as many as keep a task's pairs
    of words bounded. A round of expectation needs of other blocks only what a
    source word is expected to render in all, a number a word. The driver holds
    the vocabulary and what is likely, never a paragraph.
    """
    stated = lambda df, a, b: df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where((F.length("a") > 0) & (F.length("b") > 0)).distinct()
    pairs = stated(alignment, "source_text", "target_text")
    if glossary is not None:
        pairs = pairs.unionByName(stated(glossary, "source", "target"))
    bags = cut(map_batches(pairs, ["a", "b"], _bags, BAGS))
    entry = lambda side, word, n: F.struct(F.lit(side).alias("side"), word.alias("word"), n.cast("bigint").alias("n"))
    entries = F.concat(
        F.transform("s", lambda w: entry("a", w, F.lit(1))), F.transform(F.arrays_zip("t", "n"), lambda x: entry("b", x["t"], x["n"])), F.array(entry("pairs", F.lit(""), F.size("s").cast("bigint") * F.size("t")))
    )
    counts: dict[str, dict[tuple[bool, str], int]] = {"a": {}, "b": {}, "pairs": {}}
    told = bags.select("han", F.explode(entries).alias("x")).groupBy("han", "x.side", "x.word").agg(F.sum("x.n").alias("n")).toArrow()
    for han, side, word, n in sorted(zip(*(told.column(c).to_pylist() for c in ("han", "side", "word", "n")), strict=True)):
        counts[side][han, word] = n
    source, target = counts["a"], counts["b"]
    s, t, p = _fitted(bags, list(source), list(target), sum(counts["pairs"].values()))
    out = {}
    for flag in (False, True):
        own = [{w: n for (han, w), n in x.items() if han == flag} for x in (source, target)]
        first = [len(x) - len(y) if flag else 0 for x, y in zip((source, target), own, strict=True)]
        here = (t >= first[1]) & (t < first[1] + len(own[1]))
        out[flag] = Lexicon(*own, s[here] - first[0], t[here] - first[1], p[here])
    return out


_HAN_PAIR = re.compile("[一-鿿]{2}")


def _bags(batch: pa.RecordBatch) -> dict:
    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    counts = [Counter(w for w in tokens(x) if w[0] != "#") for x in b]
    return {
        "han": pa.array([bool(_HAN_PAIR.search(x)) for x in b], pa.bool_()), "s": pa.array([["", *sorted({w for w in tokens(x) if w[0] != "#"})] for x in a], pa.list_(pa.string())),
        "t": pa.array([list(x) for x in counts], pa.list_(pa.string())), "n": pa.array([list(x.values()) for x in counts], pa.list_(pa.int64())),
    }


def _fitted(bags: DataFrame, source: list[tuple[bool, str]], target: list[tuple[bool, str]], together: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, target, probability) by places in the lists of all that is likely; ``together``: pairs of words over all paragraphs."""
    spark = bags.sparkSession
    if not target:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    n_blocks = max(2 * spark.sparkContext.defaultParallelism, -(-min(together, len(source) * len(target)) // FITTED))
    ship(spark)
    paragraphs = cut(bags.mapInArrow(_dealt(source, target, n_blocks), FIT))
    rows = paragraphs
    totals = None
    for _ in range(ROUNDS):
        expected = cut(rows.repartition(n_blocks, "block").sortWithinPartitions("block", "part").mapInArrow(_expected(totals, len(target)), FIT))
        sums = expected.select(F.explode(F.arrays_zip("s", "v")).alias("x")).groupBy("x.s").agg(F.sum("x.v").alias("v")).toArrow()
        totals = np.zeros(len(source))
        totals[sums.column("s").to_numpy()] = sums.column("v").to_numpy()
        rows = expected.unionByName(paragraphs)
    likely = map_batches(expected, ["s", "t", "v"], _likely(totals), "s int, t int, p double").toArrow()
    return likely.column("s").to_numpy().astype(np.int64), likely.column("t").to_numpy().astype(np.int64), likely.column("p").to_numpy()


def _dealt(source: list[tuple[bool, str]], target: list[tuple[bool, str]], n_blocks: int):
    """The words of a paragraph by number, a row for each block that has words of its target."""

    def run(batches):
        of_source, of_target = ({x: i for i, x in enumerate(names)} for names in (source, target))
        out: list[dict] = []
        held = 0
        for batch in batches:
            for han, a, b, n in zip(*(batch.column(c).to_pylist() for c in ("han", "s", "t", "n")), strict=True):
                s = [of_source[han, w] for w in a]
                blocks: dict[int, tuple[list[int], list[int]]] = {}
                for w, k in zip(b, n, strict=True):
                    t = of_target[han, w]
                    t_own, n_own = blocks.setdefault(t % n_blocks, ([], []))
                    t_own.append(t)
                    n_own.append(k)
                for block, (t_own, n_own) in blocks.items():
                    out.append({"block": block, "part": 1, "s": s, "t": t_own, "v": n_own})
                    held += len(s) + len(t_own)
                    if held >= WEIGHED:
                        yield pa.RecordBatch.from_pylist(out, _FIT)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _FIT)

    return run


def _expected(totals: np.ndarray | None, width: int):
    """How often each pair of a block's words is expected to render each other, by the round before or, without one, by chance.

    A block's rows follow one another, those of the round before first. A task
    holds one block's pairs of words and one batch of paragraphs.
    """

    def run(batches):
        block = None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, parts = batch.column("block").to_numpy(), batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(parts) != 0)) + 1).tolist(), len(blocks)]
            for x, y in zip(edges, edges[1:], strict=False):
                if blocks[x] != block:
                    if block is not None:
                        yield from _rows(block, *sums.all(), width)
                    block, sums = int(blocks[x]), _Sums(totals, width)
                lists = [batch.column(c).slice(x, y - x) for c in ("s", "t", "v")]
                (sums.weigh if parts[x] else sums.before)(*lists)
        if block is not None:
            yield from _rows(block, *sums.all(), width)

    return run


def _rows(block: int, keys: np.ndarray, sums: np.ndarray, width: int):
    for i in range(0, len(keys), 1 << 16):
        own = slice(i, i + (1 << 16))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in ((keys[own] // width).astype(np.int32), (keys[own] % width).astype(np.int32), sums[own])]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), *lists], schema=_FIT)


class _Sums:
    """Expected counts of the pairs of words of one block; a pair's key is source * width + target."""

    def __init__(self, totals: np.ndarray | None, width: int) -> None:
        self.totals, self.width = totals, width
        self.keys, self.sums, self.p = np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_new = 0
        self.sorted = False

    def before(self, s: pa.ListArray, t: pa.ListArray, v: pa.ListArray) -> None:
        """What the round before expected."""
        s, t, v = (x.flatten().to_numpy() for x in (s, t, v))
        self.keys = np.concatenate((self.keys, s.astype(np.int64) * self.width + t))
        total = self.totals[s]
        self.p = np.concatenate((self.p, np.divide(v, total, out=np.zeros(len(v)), where=total > 0)))

    def weigh(self, s: pa.ListArray, t: pa.ListArray, v: pa.ListArray) -> None:
        """Paragraphs: each occurrence of a target word is shared out among the source's words."""
        if self.totals is not None and not self.sorted:
            order = np.argsort(self.keys)
            self.keys, self.p, self.sums, self.sorted = self.keys[order], self.p[order], np.zeros(len(order)), True
        s_at, t_at = s.offsets.to_numpy(), t.offsets.to_numpy()
        s, t, n = s.values.to_numpy().astype(np.int64), t.flatten().to_numpy(), v.flatten().to_numpy()
        row = np.repeat(np.arange(len(t_at) - 1), np.diff(t_at))
        ends = np.cumsum(np.diff(s_at)[row])
        start = 0
        while start < len(t):  # steps of whole target words
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WEIGHED, "right")))
            own = row[start:end]
            at, size = _ranges(s_at[own], s_at[own + 1])
            place = np.repeat(np.arange(end - start), size)
            key = s[at] * self.width + t[start:end][place]
            if self.totals is None:
                share = (n[start:end] / size)[place]
            else:
                pair = np.searchsorted(self.keys, key)
                p = self.p[pair]
                share = p * (n[start:end] / np.bincount(place, p))[place]
            share = np.rint(share / GRAIN) * GRAIN
            if self.totals is None:
                self._add(key, share)
            else:
                self.sums += np.bincount(pair, share, len(self.keys))
            start = end

    def _add(self, key: np.ndarray, share: np.ndarray) -> None:
        keys, pair = np.unique(key, return_inverse=True)
        self.new.append((keys, np.bincount(pair, share, len(keys))))
        self.n_new += len(keys)
        if self.n_new > max(FITTED, len(self.keys)):
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and sums so far."""
        if self.new:
            parts, self.new, self.n_new = [(self.keys, self.sums), *self.new], [], 0
            self.keys, pair = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            self.sums = np.bincount(pair, np.concatenate([v for _, v in parts]), len(self.keys))
        return self.keys, self.sums


def _likely(totals: np.ndarray):
    def run(batch: pa.RecordBatch) -> dict:
        s, t, v = (batch.column(c).flatten().to_numpy() for c in ("s", "t", "v"))
        kept = v > LEAST_LIKELY * totals[s]
        return {"s": pa.array(s[kept]), "t": pa.array(t[kept]), "p": pa.array(v[kept] / totals[s[kept]])}

    return run


def align_books(segments: DataFrame, books: DataFrame, alignment: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Pairs of sentences of source books and their editions that render each other.

    Needs ``book_id, id, ord, kind, text``, ``book_id, source_book_id`` and
    ``source_text, target_text``, and of a glossary ``source, target``; other
    columns are ignored. Null and empty
    texts and other kinds than paragraphs give no sentence, a book without an
    edition no row, an edition whose source is missing no row, empty tables no
    rows; a row delivered twice counts once. Without confirmed paragraphs only
    numbers and names are compared.

    A book is aligned in blocks of its segments, each of which also sees the
    segments around it, so no task ever holds more than a block. A target
    segment's home is where the anchors around it point to, else where those of
    the nearest anchored segments do, else its place in proportion; it is held
    against every other place that its anchors point to as well, and of all that
    is found for a sentence the best explained stays.
    """
    lexicons = train(alignment, glossary)
    pairs = books.where(F.col("source_book_id").isNotNull()).select(F.col("source_book_id").cast("string").alias("book_a"), F.col("book_id").cast("string").alias("book_b")).distinct()
    wanted = pairs.select(F.col("book_a").alias("book_id")).unionByName(pairs.select(F.col("book_b").alias("book_id"))).distinct()
    paragraphs = segments.where((F.col("kind") == "paragraph") & (F.length("text") > 0)).select(
        F.col("book_id").cast("string").alias("book_id"), F.col("id").cast("string").alias("id"), F.col("ord").cast("int").alias("ord"), F.col("text").cast("string").alias("text")
    )
    paragraphs = paragraphs.join(wanted, "book_id", "left_semi").distinct()
    whole = cut(map_batches(paragraphs, ["book_id", "id", "ord", "text"], _split, SENTENCES))
    last = segments.select(F.col("book_id").cast("string").alias("book_id"), F.col("ord").cast("int").alias("ord")).join(wanted, "book_id", "left_semi").groupBy("book_id").agg(F.max("ord").alias("last"))
    pairs = pairs.join(last.withColumnsRenamed({"book_id": "book_a", "last": "last_a"}), "book_a").join(last.withColumnsRenamed({"book_id": "book_b", "last": "last_b"}), "book_b")
    placed = cut(_placed(whole, pairs, lexicons))

    parts = whole.select("book_id", "id", "ord", F.posexplode(F.arrays_zip("sentences", "han")).alias("sent", "s"))
    parts = parts.select("book_id", "id", "ord", (F.col("sent") + 1).alias("sent"), F.col("s.sentences").alias("words"), F.col("s.han").alias("han"))
    side_a = parts.join(pairs, F.col("book_id") == F.col("book_a")).withColumns({"at": F.col("ord").cast("double"), "side": F.lit("a"), "away": F.lit(False)})
    spots = placed.groupBy("book_a", "book_b", "ord").agg(F.max(F.when(F.col("home"), F.col("at"))).alias("near"), F.collect_set(F.when(~F.col("home"), F.col("at"))).alias("others"))
    side_b = parts.join(pairs, F.col("book_id") == F.col("book_b")).join(spots, ["book_a", "book_b", "ord"], "left")
    side_b = _carried(side_b, placed)
    in_proportion = F.col("ord") * F.col("last_a") / F.greatest(F.col("last_b"), F.lit(1))
    bounded = lambda x: F.greatest(F.lit(1.0), F.least(x, F.col("last_a").cast("double")))
    side_b = side_b.withColumn("near", bounded(F.coalesce("near", F.col("line") + F.col("ord"), in_proportion)))
    n_blocks = F.floor((F.col("last_a") - 1) / BLOCK)
    home_of = lambda x: F.least(F.floor(F.greatest(x - 1, F.lit(0.0)) / BLOCK), n_blocks)
    elsewhere = F.filter(F.coalesce("others", F.array().cast("array<double>")), lambda x: home_of(bounded(x)) != home_of(F.col("near")))
    spread = F.concat(F.array(F.struct(F.col("near").alias("at"), F.lit(False).alias("away"))), F.transform(elsewhere, lambda x: F.struct(bounded(x).alias("at"), F.lit(True).alias("away"))))
    side_b = side_b.withColumn("spot", F.explode(spread)).withColumns({"at": F.col("spot.at"), "away": F.col("spot.away"), "side": F.lit("b")})
    names = ["book_a", "book_b", "last_a", "at", "away", "side", "ord", "id", "sent", "words", "han"]
    both = side_a.select(names).unionByName(side_b.select(names)).withColumn("home", home_of(F.col("at")))
    first = F.greatest(F.lit(0), F.floor((F.col("at") - 1 - MARGIN) / BLOCK))
    final = F.least(n_blocks, F.floor((F.col("at") - 1 + MARGIN) / BLOCK))
    blocks = both.withColumn("block", F.explode(F.sequence(F.least(first, F.col("home")), F.greatest(final, F.col("home")))))
    blocks = blocks.withColumn("at_home", F.col("home") == F.col("block"))

    def run(key: tuple, group: dict[str, list]) -> list[tuple]:
        source: list[tuple] = []
        targets: dict[bool, dict[tuple, tuple]] = {False: {}, True: {}}
        for side, away, order, segment, sent, words, han, home in zip(*group.values(), strict=True):
            if side == "a":
                source.append((segment, sent, _words(words)))
            elif (order, segment, sent) not in targets[away]:  # the row at home comes first
                targets[away][order, segment, sent] = (segment, sent, _words(words), han, home)
        rows = []
        for away, found in targets.items():
            b = list(found.values())
            if not any(x[4] for x in b):
                continue
            lexicon = lexicons[sum(x[3] for x in b) * 2 > len(b)]
            for i, j, gain in align([x[2] for x in source], [x[2] for x in b], lexicon):
                if b[j][4]:
                    rows.append((key[0], source[i][0], source[i][1], key[1], b[j][0], b[j][1], gain, away, key[2]))
        return rows

    group, columns = ["book_a", "book_b", "block"], ["side", "away", "ord", "id", "sent", "words", "han", "at_home"]
    blocks = blocks.withColumn("later", (~F.col("at_home")).cast("int"))
    found = map_groups(blocks, group, ["ord", "id", "sent", "later"], columns, run, PAIRS + ", away boolean, block bigint")
    rank = F.struct((F.col("gain") - F.when(F.col("away"), AWAY_COST).otherwise(0.0)).alias("gain"), (~F.col("away")).alias("here"), (-F.col("block")).alias("block"))
    found = found.withColumn("rank", rank).withColumn("best", F.max("rank").over(Window.partitionBy("book_a", "book_b", "id_b", "sent_b")))
    kept = found.where((F.col("rank.here") == F.col("best.here")) & (F.col("rank.block") == F.col("best.block")))
    return kept.select("book_a", "id_a", "sent_a", "book_b", "id_b", "sent_b", "gain")


def _placed(whole: DataFrame, pairs: DataFrame, lexicons: dict[bool, Lexicon]) -> DataFrame:
    """``book_a, book_b, ord, at, home``: where in the source the anchors around each target order point to.

    An anchor found in at most three segments of either book is joined within
    the pair; counts, least, greatest and sum name those segments, so nothing is
    collected and a frequent anchor costs no more than a rare one.
    """
    roles = pairs.select(F.col("book_a").alias("book_id"), F.lit("a").alias("side")).unionByName(pairs.select(F.col("book_b").alias("book_id"), F.lit("b").alias("side"))).distinct()
    rows = whole.join(roles, "book_id").withColumn("han", F.exists("han", lambda x: x))
    found = map_batches(rows, ["book_id", "side", "ord", "han", "sentences"], _anchors(lexicons), ANCHORS)
    ends = pairs.select("book_a", "book_b", F.explode(F.array(F.struct(F.col("book_a").alias("book_id"), F.lit("a").alias("side")), F.struct(F.col("book_b").alias("book_id"), F.lit("b").alias("side")))).alias("end"))
    ends = ends.select("book_a", "book_b", "end.book_id", "end.side")
    own = lambda side: F.when(F.col("side") == side, F.col("ord"))
    sums = {f"{f.__name__}_{s}": f(own(s)) for s in "ab" for f in (F.count, F.min, F.max, F.sum)}
    rare = found.join(ends, ["book_id", "side"]).groupBy("book_a", "book_b", "anchor").agg(*[c.alias(k) for k, c in sums.items()])
    rare = rare.where(F.col("count_a").between(1, 3) & F.col("count_b").between(1, 3))
    spots = lambda s: F.slice(F.array(F.col(f"min_{s}"), F.col(f"max_{s}"), (F.col(f"sum_{s}") - F.col(f"min_{s}") - F.col(f"max_{s}")).cast("int")), 1, F.col(f"count_{s}"))
    votes = rare.select("book_a", "book_b", (1 / (F.col("count_a") * F.col("count_b"))).alias("w"), spots("a").alias("as"), spots("b").alias("bs"))
    votes = votes.select("book_a", "book_b", "w", "bs", F.explode("as").alias("ord_a")).select("book_a", "book_b", "w", "ord_a", F.explode("bs").alias("ord_b"))
    votes = votes.groupBy("book_a", "book_b", "ord_a", "ord_b").agg(F.least(F.sum("w"), F.lit(MOST_VOTES)).alias("w"))
    bucket = lambda x: F.floor(x / BLOCK)
    votes = votes.withColumn("bucket", F.explode(F.sequence(bucket(F.col("ord_b") - REACH), bucket(F.col("ord_b") + REACH))))

    def run(key: tuple, group: dict[str, list]) -> list[tuple]:
        out = places(np.array(group["ord_a"]), np.array(group["ord_b"]), np.array(group["w"]), key[2] * BLOCK, BLOCK)
        return [(key[0], key[1], *x) for x in out]

    return map_groups(votes, ["book_a", "book_b", "bucket"], ["ord_b", "ord_a"], ["ord_a", "ord_b", "w"], run, PLACES)


def _carried(side_b: DataFrame, placed: DataFrame) -> DataFrame:
    """``line``: source position less target order of the nearest placed block of target orders before, else after, each row."""
    group = ["book_a", "book_b"]
    bucket = F.floor(F.col("ord") / BLOCK)
    side_b = side_b.withColumn("bucket", bucket)
    lines = placed.where("home").groupBy(*group, bucket.alias("bucket")).agg(F.max_by(F.col("at") - F.col("ord"), "ord").alias("end"), F.min_by(F.col("at") - F.col("ord"), "ord").alias("begin"))
    all_ = side_b.select(*group, "bucket").distinct().join(lines, [*group, "bucket"], "left")
    before = Window.partitionBy(*group).orderBy("bucket")
    after = before.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    carried = all_.select(*group, "bucket", F.coalesce(F.last("end", ignorenulls=True).over(before), F.first("begin", ignorenulls=True).over(after)).alias("line"))
    return side_b.join(carried, [*group, "bucket"], "left").drop("bucket")
