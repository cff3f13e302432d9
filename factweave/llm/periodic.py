"""Periodic runs of words (operator 12)."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factweave.llm.common import documents

#: A difference cover: every difference modulo ``CYCLE`` is one between two of these.
CYCLE, COVER = 21, (0, 1, 4, 14, 16)
#: Words of texts that are worked on together, and pairs of positions of one step.
LOT, STEP = 400_000, 1_000_000


class Extensions:
    """Longest common extensions of positions in an array of word numbers, by a difference cover.

    Only the suffixes at positions of the cover (5 of 21) are sorted: by blocks of ``CYCLE`` words, and where these agree by
    doubling. The common blocks of neighbours in this order go into a sparse table of minima. Two positions are at most
    ``CYCLE - 1`` words before two of the cover; these words are compared, then the table tells how many blocks follow alike,
    and the words of the first block that differs are compared.
    """

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        per = -(-self.n // CYCLE) + 1  # blocks in a row of the cover, the last one past the end
        # past the end stand numbers that no word has
        self.words = np.concatenate([words, -1 - np.arange((per + 2) * CYCLE - self.n, dtype=words.dtype)])
        self.per, self.size = per, per * len(COVER)
        at = (np.array(COVER)[:, None] + CYCLE * np.arange(per)[None, :]).ravel()
        row = np.full(CYCLE, -1)
        row[list(COVER)] = np.arange(len(COVER))
        self.row = row
        # how far to go from residues (a, b) to two of the cover
        self.shift = np.array([[min(d for d in range(CYCLE) if row[(a + d) % CYCLE] >= 0 and row[(b + d) % CYCLE] >= 0) for b in range(CYCLE)] for a in range(CYCLE)])
        self._sort(self._blocks(at))

    def _blocks(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the blocks of words at ``at``, equal for equal blocks; any order of blocks does."""
        odd = np.random.default_rng(7).integers(1, 1 << 62, CYCLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        mixed = self.words.astype(np.uint64)
        key = np.zeros(len(at), np.uint64)
        for t in range(CYCLE):
            key += mixed[at + t] * odd[t]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        a, b = at[order[1:][same]], at[order[:-1][same]]
        if any((self.words[a + t] != self.words[b + t]).any() for t in range(CYCLE)):  # two blocks share a hash: sort the words
            order = np.lexsort([self.words[at + t] for t in range(CYCLE)])
            same = np.logical_and.reduce([self.words[at[order[1:]] + t] == self.words[at[order[:-1]] + t] for t in range(CYCLE)])
        out = np.empty(len(at), np.int64)
        out[order] = np.concatenate([[0], np.flatnonzero(~same) + 1])[np.concatenate([[0], np.cumsum(~same)])]
        return out

    def _sort(self, rank: np.ndarray) -> None:
        """Sorts the sampled suffixes by blocks; ranks are places of the first of a group, so settled ones stay."""
        per, m = self.per, self.size
        order = np.argsort(rank, kind="stable")
        levels, width = [rank.astype(np.int32)], 1
        while width < per:
            counts = np.bincount(rank, minlength=m)
            open_ = order[counts[rank[order]] > 1]  # in order of rank
            if not len(open_):
                break
            column = open_ % per
            after = np.where(column + width < per, rank[np.minimum(open_ + width, m - 1)] + 1, 0)
            by = np.lexsort([after, rank[open_]])
            open_, after = open_[by], after[by]
            group = rank[open_]
            start = np.concatenate([[True], group[1:] != group[:-1]])
            new = start | np.concatenate([[True], after[1:] != after[:-1]])
            place = np.arange(len(open_)) - np.maximum.accumulate(np.where(start, np.arange(len(open_)), 0))
            first = np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))
            offset = place[first]
            order[group + place] = open_
            rank = rank.copy()
            rank[open_] = group + offset
            levels.append(rank.astype(np.int32))
            width *= 2
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        # blocks that neighbours have in common, from the ranks of each doubling
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(m - 1, np.int32)
        live = np.flatnonzero(levels[0][a] == levels[0][b])
        for level in range(len(levels) - 1, -1, -1):
            x, y = a[live] + common[live], b[live] + common[live]
            fits = (a[live] % per + common[live] < per) & (b[live] % per + common[live] < per)
            x, y = np.minimum(x, m - 1), np.minimum(y, m - 1)
            common[live[fits & (levels[level][x] == levels[level][y])]] += 1 << level
        self.table = [common]
        while 2 << (len(self.table) - 1) <= m - 1:
            low, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(low[:-half], low[half:]))

    def _blocks_alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common blocks of suffixes at two different positions of the cover."""
        i, j = (self.rank[self.row[x % CYCLE] * self.per + x // CYCLE] for x in (a, b))
        low, high = np.minimum(i, j), np.maximum(i, j)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out

    def _few(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and ``b`` on, at most ``most`` (under ``CYCLE``)."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for t in range(CYCLE):
            live = live[(most[live] > t) & (self.words[a[live] + t] == self.words[b[live] + t])]
            if not len(live):
                break
            out[live] = t + 1
        return out

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of each ``a < b``."""
        to = self.shift[a % CYCLE, b % CYCLE]
        out = self._few(a, b, to)
        on = np.flatnonzero(out == to)
        x, y = a[on] + to[on], b[on] + to[on]
        inside = y < self.n
        on, x, y = on[inside], x[inside], y[inside]
        far = CYCLE * self._blocks_alike(x, y)
        out[on] += far + self._few(x + far, y + far, np.full(len(on), CYCLE - 1))
        return out


def runs(words: np.ndarray, ends: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all maximal runs in texts that stand one behind the other.

    ``words``: numbers of words, with one of its own between texts; ``ends``: where each text ends, shortest text first. A run
    of period ``p`` and length ``2 p`` or more holds two positions ``k p`` and ``(k + 1) p`` with the same word, so these pairs
    (a harmonic number of them in all) are looked at, and extended in both directions. Runs have at least ``least`` words.
    """
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes = ends - starts
    longest = int(sizes.max(initial=0))
    if longest < least:
        return (np.zeros(0, np.int64),) * 3
    forward, backward = Extensions(words), Extensions(words[::-1].copy())
    n = len(words)
    found: list[np.ndarray] = []

    def extend(at: np.ndarray, period: np.ndarray) -> None:
        need = np.maximum(period, least - period)
        ahead = forward.of(at, at + period)
        live = np.flatnonzero(at > 0)
        back = np.zeros(len(at), np.int64)
        # reversed, position i is n - 1 - i; the words before the pair
        back[live] = backward.of(n - at[live] - period[live], n - at[live])
        ok = ahead + back >= need
        start, length, period = (at - back)[ok], (ahead + back + period)[ok], period[ok]
        found.append(np.unique(np.stack([start, length, period]), axis=1))

    lot: list[tuple[np.ndarray, int]] = []
    held = 0
    # texts with fewer than 2 p words have no run of period p
    first = np.searchsorted(sizes, 2 * np.arange(longest // 2 + 1), "left")
    for p in range(1, longest // 2 + 1):
        low = -(-int(starts[first[p]]) // p) * p
        at = low + p * np.flatnonzero(words[low : n - p : p] == words[low + p : n : p])
        if len(at):
            lot.append((at, p))
            held += len(at)
        if held and (held >= STEP or p == longest // 2):
            for at, period in _near(words, np.concatenate([a for a, _ in lot]), np.concatenate([np.full(len(a), q) for a, q in lot])):
                extend(at, period)
            lot, held = [], 0
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort([period, length, start])  # of those with one extent, the smallest period
    start, length, period = start[order], length[order], period[order]
    one = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])[: len(start)]
    return start[one], length[one], period[one]


def _near(words: np.ndarray, at: np.ndarray, period: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of pairs with the same word those that agree in the next three words or in the three before: a run of 12 words has six
    equal pairs in line, so it agrees in four from a pair on or in three before it."""
    n = len(words)

    def same(step: int) -> np.ndarray:
        a = at + step
        inside = (a >= 0) & (a + period < n)
        return inside & (words[np.where(inside, a, 0)] == words[np.where(inside, a + period, 0)])

    keep = (same(1) & same(2) & same(3)) | (same(-1) & same(-2) & same(-3))
    at, period = at[keep], period[keep]
    for k in range(0, len(at), STEP):
        yield at[k : k + STEP], period[k : k + STEP]


def planted_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the period that a document's number plants in them, if any (null: none)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), n - a))


def _collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by blanks."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(itertools.compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


EMPTY = hashlib.sha256(b"").hexdigest()


def _scan(lot: list[list[bytes]], least: int) -> list[tuple]:
    """``n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of each list of words."""
    order = sorted(range(len(lot)), key=lambda i: len(lot[i]))
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    parts, ends, total = [], [], 0
    for k, i in enumerate(order):
        parts.append(np.fromiter(map(number.__getitem__, lot[i]), np.int64, len(lot[i])))
        parts.append(np.array([-1_000_000_000 - k]))  # parts this text from the next
        total += len(lot[i])
        ends.append(total)
        total += 1
    at = np.array(ends, np.int64)
    start, length, period = runs(np.concatenate(parts), at, least)
    of_text = np.searchsorted(at, start, "right")
    cuts = np.searchsorted(of_text, np.arange(len(order) + 1))
    out: list[tuple] = [()] * len(lot)
    for k, i in enumerate(order):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            out[i] = (0, None, None, None, None, EMPTY, hashlib.sha256(_collapse(lot[i], [])).hexdigest())
            continue
        base = ends[k] - len(lot[i])
        found = sorted(zip((start[a:b] - base).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True), key=lambda r: (r[0], r[2]))
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
        lines = "".join(f"{x},{y},{z}\n" for x, y, z in found).encode()
        out[i] = (len(found), s, n, q, 1000 * n // q, hashlib.sha256(lines).hexdigest(), hashlib.sha256(_collapse(lot[i], found)).hexdigest())
    return out


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, least: int = 12, plant: bool = False) -> DataFrame:
    """All maximal runs of words of each text: stretches of ``least`` words or more that repeat their first ``period`` words.

    Returns one row per row of ``docs``: ``doc_id``, the number of runs, the longest (ties: the first, then the smallest period; none: nulls), digests of
    all runs and of the text without what they repeat. Whole texts are scanned, in one pass and without a shuffle; texts are
    worked on together up to about 400,000 words, a longer text by itself. Null and empty texts have no runs; rows are
    scanned each for itself, repeats too; no rows give none; other columns are ignored. ``plant`` first writes a period into
    the documents that their number chooses, for tests at scale; a null ``doc_id`` chooses none.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]

    def flush(id_type: pa.DataType, ids: list, lot: list[list[bytes]]) -> pa.RecordBatch:
        rows = list(zip(*_scan(lot, least), strict=True))
        columns = [pa.array(c, pa.string() if x.endswith("256") else pa.int64()) for x, c in zip(names, rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns], ["doc_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lot, held = [], [], 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                ids.append(doc_id.as_py())
                lot.append(planted_words(words, ids[-1]) if plant else words)
                held += len(words) + 1
                if held >= LOT:
                    yield flush(id_type, ids, lot)
                    ids, lot, held = [], [], 0
        if ids:
            yield flush(id_type, ids, lot)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 words or more of all documents."""
    return periodic_runs(documents(spark, sf_dir), plant=True)
