"""Problem 7: held-out passages inside the corpus, by Wu-Manber search.

A passage is cut into overlapping test strings of one length. A shift table
over blocks of symbols tells how far the search may jump, buckets by the hash of
the whole window pick the test strings that may end there, and a comparison
symbol by symbol confirms them. Every text and passage with a hit are a candidate
pair, whose runs are then measured symbol by symbol with small edits, all hits of
a batch at once.

The search runs over all documents of an Arrow batch at once: each text is
divided into lanes, every lane has its own cursor, and a step moves all cursors
by their own shifts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.arrow import code_points, map_batches
from quirework.session import cut

#: Test strings: symbols, step between two, symbols in a block of the shift table.
LATIN_SHAPE = (20, 5, 8)
HAN_SHAPE = (8, 2, 3)
SHORT_SHAPE = (4, 1, 2)
#: Share of a passage that makes a case, in at most two runs; a run has the length of a test string at least.
LEAST_SHARE = 0.5
#: Characters of passages that one search, and the driver, hold at a time; more are searched in further blocks.
BLOCK_CHARS = 4_000_000
LANE = 512
TABLE_BITS = 22


@lru_cache(1)
def _normal() -> np.ndarray:
    """Code point -> symbol: letters and digits without case and accent, 0 for the rest. Ideographs keep their own symbol."""
    table = np.zeros(0x110000, np.uint16)
    for p in range(0x30, 0x3400):
        c = chr(p)
        if unicodedata.category(c)[0] not in "LN":
            continue
        base = unicodedata.normalize("NFKD", c.casefold())
        kept = [x for x in base if unicodedata.category(x)[0] in "LN"]
        if kept:
            table[p] = ord(kept[0]) & 0xFFFF
    table[0x3400:0xD800] = np.arange(0x3400, 0xD800, dtype=np.uint32).astype(np.uint16)
    for p in range(0xF900, 0x10000):
        base = unicodedata.normalize("NFKC", chr(p)).casefold()
        if base and unicodedata.category(base[0])[0] in "LN":
            table[p] = ord(base[0]) & 0xFFFF
    for p in range(0x1D400, 0x1D800):
        base = unicodedata.normalize("NFKC", chr(p)).casefold()
        table[p] = table[ord(base[0])] if ord(base[0]) < 0x10000 else 0
    table[0x20000:0x32000] = 0xD800 + np.arange(0x12000) % 0x800
    return table


def symbols(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts end to end, and offsets by row."""
    points, offsets = code_points(array)
    mapped = _normal()[points]
    kept = np.zeros(len(points) + 1, np.int64)
    np.cumsum(mapped != 0, out=kept[1:])
    return mapped[mapped != 0], kept[offsets]


class Searcher:
    """Shift table and buckets for the test strings of one shape."""

    def __init__(self, items: list[tuple[int, np.ndarray]], shape: tuple[int, int, int]) -> None:
        self.m, step, self.block = shape
        m, block = self.m, self.block
        strings, owner, at = [], [], []
        for k, (_, s) in enumerate(items):
            if len(s) < m:
                continue
            starts = list(range(0, len(s) - m + 1, step))
            if starts[-1] != len(s) - m:
                starts.append(len(s) - m)
            for a in starts:
                strings.append(s[a : a + m])
                owner.append(k)
                at.append(a)
        generator = np.random.default_rng(7)
        self.block_weights = generator.integers(1, 1 << 62, block, dtype=np.uint64) | np.uint64(1)
        self.window_weights = generator.integers(1, 1 << 62, m, dtype=np.uint64) | np.uint64(1)
        self.shift = np.full(1 << TABLE_BITS, m - block + 1, np.uint8)
        self.empty = not strings
        if self.empty:
            return
        matrix = np.stack(strings)
        hashes = (matrix.astype(np.uint64) * self.window_weights).sum(1)
        order = np.argsort(hashes, kind="stable")
        matrix, hashes = matrix[order], hashes[order]
        owner, at = np.array(owner)[order], np.array(at)[order]
        # equal strings of several places share one entry
        first = np.ones(len(hashes), bool)
        first[1:] = (matrix[1:] != matrix[:-1]).any(1) | (hashes[1:] != hashes[:-1])
        self.strings, self.hashes = matrix[first], hashes[first]
        self.start = np.append(np.flatnonzero(first), len(hashes))
        self.owner, self.at = owner, at
        for end in range(block, m + 1):
            key = self.key(self.strings[:, end - block : end])
            np.minimum.at(self.shift, key, np.uint8(m - end))

    def key(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks.astype(np.uint64) * self.block_weights).sum(1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window starts, test strings) of all occurrences."""
        none = np.empty(0, np.int64)
        if self.empty or not len(text):
            return none, none
        m, block = self.m, self.block
        lengths = offsets[1:] - offsets[:-1]
        lanes = np.maximum(0, -(-(lengths - m + 1) // LANE))
        row = np.repeat(np.arange(len(lengths)), lanes)
        number = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        cursor = offsets[row] + number * LANE + m - 1  # the window's last symbol
        stop = np.minimum(cursor + LANE, offsets[row + 1])
        back = np.arange(-block + 1, 1)
        candidates = []
        while len(cursor):
            shift = self.shift[self.key(text[cursor[:, None] + back])]
            hit = shift == 0
            if hit.any():
                candidates.append(cursor[hit] - m + 1)
            cursor = cursor + np.maximum(shift, 1)
            going = cursor < stop
            cursor, stop = cursor[going], stop[going]
        if not candidates:
            return none, none
        starts, strings = [], []
        found = np.concatenate(candidates)
        for i in range(0, len(found), 200_000):
            part = found[i : i + 200_000]
            windows = text[part[:, None] + np.arange(m)]
            value = (windows.astype(np.uint64) * self.window_weights).sum(1)
            bucket = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
            same = (self.hashes[bucket] == value) & (self.strings[bucket] == windows).all(1)
            starts.append(part[same])
            strings.append(bucket[same])
        return np.concatenate(starts), np.concatenate(strings)


def _shape(s: np.ndarray) -> tuple[int, int, int]:
    if len(s) < 4 * HAN_SHAPE[0]:
        return SHORT_SHAPE
    if (s >= 0x2E80).mean() > 0.3 or len(s) < 4 * LATIN_SHAPE[0]:
        return HAN_SHAPE
    return LATIN_SHAPE


class Index:
    """The searchers of a block of items, by shape."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        data, offsets = symbols(pa.array([t for _, t in items], pa.string()))
        self.data, self.starts = data, offsets
        self.items = [(i, data[offsets[k] : offsets[k + 1]]) for k, (i, _) in enumerate(items)]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.searchers = []
        for shape in (LATIN_SHAPE, HAN_SHAPE, SHORT_SHAPE):
            own = [k for k, (_, s) in enumerate(self.items) if len(s) and _shape(s) == shape]
            if own:
                self.searchers.append((Searcher([self.items[k] for k in own], shape), np.array(own), shape))

    def leaks(self, array: pa.Array) -> list[tuple[int, int, float]]:
        """(row, item id, share) of every passage that a text contains."""
        text, offsets = symbols(array)
        out: list[tuple[int, int, float]] = []
        for searcher, own, shape in self.searchers:
            starts, strings = searcher.search(text, offsets)
            if not len(starts):
                continue
            times = searcher.start[strings + 1] - searcher.start[strings]
            place = np.repeat(searcher.start[strings], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            where = np.repeat(starts, times)
            item = own[searcher.owner[place]]
            row = np.searchsorted(offsets, where, side="right") - 1
            out += self._measure(text, offsets, row, item, where, searcher.at[place], shape[0])
        return out

    def _measure(self, text, offsets, row, item, where, at, m) -> list[tuple[int, int, float]]:
        """Shares of all pairs with a hit; ``where`` counts from the start of ``text``, ``at`` from the passage's."""
        n_items = len(self.items)
        pair = row.astype(np.int64) * n_items + item
        order = np.lexsort((at, where - at, pair))
        pair, where, at = pair[order], where[order], at[order]
        # test strings that touch one another on one line are one equal stretch
        goes_on = np.zeros(len(pair), bool)
        goes_on[1:] = (pair[1:] == pair[:-1]) & ((where - at)[1:] == (where - at)[:-1]) & (at[1:] - at[:-1] <= m)
        first = np.flatnonzero(~goes_on)
        last = np.append(first[1:], len(pair)) - 1
        pair, begin, end, place = pair[first], at[first], at[last] + m, where[first]
        r, k = np.divmod(pair, n_items)
        low, high = self.starts[k], self.starts[k + 1]
        firm = 10 if m >= 20 else 5 if m >= 8 else 3
        ends = _extend(self.data, low + end, high, text, place + (end - begin), offsets[r + 1], end - begin, firm) - low
        n, t = len(self.data), len(text)
        back = _extend(self.data[::-1], n - low - begin, n - low, text[::-1], t - place, t - offsets[r], np.full(len(r), m), firm)
        begins = n - low - back
        size = ends - begins
        length = high - low
        # two runs are at most twice the longest
        edges = np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(pair))
        longest = np.maximum.reduceat(size, edges[:-1])
        out = []
        for g in np.flatnonzero(2 * longest >= LEAST_SHARE * length[edges[:-1]]):
            a, b = edges[g], edges[g + 1]
            runs = {(x, y) for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True) if y - x >= m}
            share = _best_two(runs) / int(length[a])
            if share >= LEAST_SHARE:
                out.append((int(r[a]), int(self.ids[k[a]]), round(share, 4)))
        return out


_EDITS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2))
_WIDTH, _SEEDS = 64, 20_000


def _extend(a: np.ndarray, i: np.ndarray, a_end: np.ndarray, b: np.ndarray, j: np.ndarray, b_end: np.ndarray, done: np.ndarray, firm: int) -> np.ndarray:
    """How far ``a[i:a_end]`` and ``b[j:b_end]`` agree but for small edits, each followed by ``firm`` equal symbols, for all seeds at once.

    ``done`` is how long each run is already; a run of n symbols may have 1 + 0.06 n edits.
    """
    room = np.zeros(_WIDTH + firm + 2, a.dtype)
    a, b = np.concatenate((a, room)), np.concatenate((b, room))
    out = i.copy()
    for k in range(0, len(i), _SEEDS):
        part = slice(k, k + _SEEDS)
        out[part] = _extend_part(a, i[part].copy(), a_end[part], b, j[part].copy(), b_end[part], i[part] - done[part], firm)
    return out


def _extend_part(a, i, a_end, b, j, b_end, start, firm) -> np.ndarray:
    edits = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    ahead, near = np.arange(_WIDTH), np.arange(firm)
    while len(live):
        left = np.minimum(a_end[live] - i[live], b_end[live] - j[live])
        differ = a[i[live][:, None] + ahead] != b[j[live][:, None] + ahead]
        differ |= ahead >= left[:, None]
        run = np.where(differ.any(1), differ.argmax(1), _WIDTH)
        i[live] += run
        j[live] += run
        going = live[run == _WIDTH]
        live = live[(run < _WIDTH) & (run < left)]
        if len(live):
            x = a[i[live][:, None] + np.arange(firm + 2)]
            y = b[j[live][:, None] + np.arange(firm + 2)]
            left_a, left_b = a_end[live] - i[live], b_end[live] - j[live]
            cost = np.zeros(len(live), np.int64)
            step_a, step_b = np.zeros_like(cost), np.zeros_like(cost)
            for di, dj in _EDITS:
                left = np.minimum(left_a - di, left_b - dj)
                same = ((x[:, di : di + firm] == y[:, dj : dj + firm]) | (near >= left[:, None])).all(1)
                fits = same & ((left >= firm) | (left > 0) & (left == left_a - di)) & (cost == 0)
                cost[fits], step_a[fits], step_b[fits] = max(di, dj), di, dj
            taken = (cost > 0) & (edits[live] + cost <= 1 + 0.06 * (i[live] + step_a - start[live]))
            live, cost, step_a, step_b = live[taken], cost[taken], step_a[taken], step_b[taken]
            edits[live] += cost
            i[live] += step_a
            j[live] += step_b
        live = np.concatenate((going, live))
    return i


def _best_two(runs: set[tuple[int, int]]) -> int:
    """How much at most two of the runs cover together, by a sweep over those that no other contains."""
    outer: list[tuple[int, int]] = []
    for a, b in sorted(runs, key=lambda r: (r[0], -r[1])):
        if not outer or b > outer[-1][1]:
            outer.append((a, b))
    best = done = longest = 0
    for a, b in outer:  # starts and ends both rise
        while outer[done][1] <= a:
            longest = max(longest, outer[done][1] - outer[done][0])
            done += 1
        best = max(best, b - a + longest, b - outer[done][0])  # with the longest that ended before, or the first that still overlaps
    return best


@lru_cache(4)
def _index(items: tuple[tuple[int, str], ...]) -> Index:
    return Index(list(items))


LEAKS = "doc_id bigint, item_id bigint, share double"


def find_leaks(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every document that contains at least half of a benchmark passage in at most two runs.

    A run is seen by a test string in it that stands unchanged: 24 letters and
    digits are sure to hold one (9 of ideographs, 4 of the shortest passages).

    Needs ``doc_id, text`` and ``item_id, text``; other columns are ignored. The
    stated passages are read in blocks of at most ``block_chars`` characters and
    each block is held against all documents. Of more than one block each one's
    pairs are written before the next is read, so neither the driver nor a task
    ever holds more than a block. Null and empty texts on either side give no
    row; a passage of fewer than four letters and digits is never searched;
    equal passages under several ids each give a row; a repeated document id
    counts once. Copies of a document give a row each. Only the found pairs are
    shuffled.
    """
    passages = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("item_id").isNotNull() & (F.length("text") > 0)).distinct()
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    found = None
    blocks = _blocks(passages.orderBy("item_id", "text").toLocalIterator(), block_chars)
    block, later = next(blocks), next(blocks, None)
    while block is not None:
        one = map_batches(rows, ["doc_id", "text"], _finder(block), LEAKS)
        one = one if found is None and later is None else cut(one)
        found = one if found is None else found.unionByName(one)
        block, later = later, next(blocks, None)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _blocks(items, most: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The passages in tuples of at most ``most`` characters; at least one tuple, which may be empty."""
    block: list[tuple[int, str]] = []
    size = 0
    for item in items:
        if block and size + len(item.text) > most:
            yield tuple(block)
            block, size = [], 0
        block.append((item.item_id, item.text))
        size += len(item.text)
    yield tuple(block)


def _finder(block: tuple[tuple[int, str], ...]):
    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").to_pylist()
        found = _index(block).leaks(batch.column("text")) if block else []
        return {"doc_id": pa.array([ids[r] for r, _, _ in found], pa.int64()), "item_id": pa.array([i for _, i, _ in found], pa.int64()), "share": pa.array([s for _, _, s in found], pa.float64())}

    return run
