"""Periodic runs of words: suffix trees answer how far two places agree, Lyndon roots say where to ask.

A run is a stretch with smallest period q and at least two periods that can't be extended either way. Ukkonen's
algorithm builds the suffix tree of a stretch of words and that of its reversal; the string depth of the lowest common
ancestor of two leaves, a range minimum over the Euler tour, is the number of words on which the two places agree, read
forwards or backwards, in constant time. By the runs theorem each run holds a Lyndon root that is the longest Lyndon
word at its start in one of the two orders of the words, that is, it ends where the next smaller (or larger) suffix
begins. So each place gives two candidates, which are extended both ways.

Trees are built only where a run can be. A run of 12 words or more, and of two periods or more, has each of its words in
some six words that occur twice in it, so words outside any six that recur in their document are left out, and so on
within what is left until nothing changes. That test is exact for every text; the trees decide what is a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import as_text

#: The shortest run.
LEAST = 12
#: Words that recur together wherever a run is. Any ``LEAST`` from twice as many on lets it hold.
_GRAM = 6
#: Words whose recurrence is looked up at a time; a longer document is taken alone.
_AT_ONCE = 200_000


class RangeMinimum:
    """Minimum of ``values[lo..hi]`` in constant time and linear space: blocks, and a sparse table over their minima."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        size = self.BLOCK
        padded = np.full(-(-len(values) // size) * size, np.iinfo(np.int32).max, np.int32)
        padded[:len(values)] = values
        blocks = padded.reshape(-1, size)
        self.values = padded
        self.to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.from_begin = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.levels = [blocks.min(axis=1)]
        while 2 ** len(self.levels) <= len(blocks):
            below, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        first, last = lo // self.BLOCK, hi // self.BLOCK
        out = np.minimum(self.to_end[lo], self.from_begin[hi])
        same = np.flatnonzero(first == last)
        if len(same):
            out[same] = self.values[lo[same]]
            for step in range(1, self.BLOCK):
                inside = same[lo[same] + step <= hi[same]]
                out[inside] = np.minimum(out[inside], self.values[lo[inside] + step])
        between = last - first - 1
        for level, minima in enumerate(self.levels):
            mine = np.flatnonzero((between >= 2 ** level) & (between < 2 ** (level + 1)))
            if len(mine):
                out[mine] = np.minimum(out[mine], np.minimum(minima[first[mine] + 1], minima[last[mine] - 2 ** level]))
        return out


class SuffixTree:
    """Suffix tree of whole numbers from 1 on, by Ukkonen's algorithm; ``rank`` of each suffix and ``agree`` of two."""

    def __init__(self, text: list[int]):
        self.text = [*text, 0]  # an end smaller than any word
        self._grow()
        self._tour()

    def _grow(self) -> None:
        """Suffixes enter from left to right; leaf ``k`` to be made is that of suffix ``k``."""
        text, size, base = self.text, len(self.text), max(self.text) + 1
        start, end, link, parent, leaf = [0], [0], [0], [0], []
        edges: dict[int, int] = {}
        node = at = along = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            made = 0
            while waiting:
                if not along:
                    at = i
                edge = node * base + text[at]
                below = edges.get(edge)
                if below is None:
                    edges[edge] = len(start)
                    leaf.append(len(start))
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    parent.append(node)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    first = start[below]
                    length = (end[below] if end[below] < i else i) - first
                    if along >= length:
                        at += length
                        along -= length
                        node = below
                        continue
                    if text[first + along] == c:
                        along += 1
                        if made:
                            link[made] = node
                        break
                    split = len(start)
                    start += (first, i)
                    end += (first + along, size)
                    link += (0, 0)
                    parent += (node, split)
                    leaf.append(split + 1)
                    edges[edge] = split
                    edges[split * base + c] = split + 1
                    start[below] = first + along
                    parent[below] = split
                    edges[split * base + text[first + along]] = below
                    if made:
                        link[made] = split
                    made = split
                waiting -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    at = i - waiting + 1
        self.start, self.end, self.parent, self.leaf = start, end, parent, leaf

    def _tour(self) -> None:
        """The Euler tour with children in order of their first word, as string depths."""
        start, parent = np.array(self.start), np.array(self.parent)
        nodes = len(start)
        child = np.lexsort((np.array(self.text)[start], parent))
        child = child[child != 0]
        bounds = np.searchsorted(parent[child], np.arange(nodes + 1))
        children, ahead, stop, above = child.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), self.parent
        length = (np.array(self.end) - start).tolist()
        depth, tour, v = [0] * nodes, [0], 0
        while True:
            at = ahead[v]
            if at < stop[v]:
                ahead[v] = at + 1
                below = children[at]
                depth[below] = depth[v] + length[below]
                v = below
            elif v:
                v = above[v]
            else:
                break
            tour.append(v)
        place = np.empty(nodes, np.int64)
        place[np.array(tour)] = np.arange(len(tour))
        self.place = place[np.array(self.leaf)]  # a leaf is met once
        self.rank = np.empty(len(self.leaf), np.int64)
        self.rank[np.argsort(self.place)] = np.arange(len(self.leaf))
        self.lowest = RangeMinimum(np.array(depth, np.int32)[np.array(tour)])
        del self.start, self.end, self.parent, self.leaf

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words on which the suffixes at ``i`` and ``j``, different ones, agree."""
        a, b = self.place[i], self.place[j]
        return self.lowest(np.minimum(a, b), np.maximum(a, b))


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next with a smaller rank, or the length."""
    out, open_ = [len(rank)] * len(rank), []
    for j, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = j
        open_.append(j)
    return out


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``start, length, period`` of each run of ``least`` words or more, by start and period."""
    n = len(words)
    if n < 2:
        return np.empty((0, 3), np.int64)
    text = (np.unique(words, return_inverse=True)[1] + 1).tolist()
    ahead, back = SuffixTree(text), SuffixTree(text[::-1])
    rank = ahead.rank[:n]
    i = np.tile(np.arange(n), 2)
    j = np.array(_next_smaller(rank.tolist()) + _next_smaller((-rank).tolist()))
    i, j = i[j < n], j[j < n]
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = back.agree(n - i[inner], n - j[inner])
    start, stop, period = i - left, j + ahead.agree(i, j), j - i
    runs = np.stack([start, stop - start, period], axis=1)[stop - start >= np.maximum(2 * period, least)]
    return np.unique(runs, axis=0)[:, [0, 1, 2]] if len(runs) else runs


_MIX = np.random.default_rng(11).integers(1, 2 ** 63, _GRAM + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def possible(words: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of one ``part`` (``begin, end``) outside which no run of 12 or more can be.

    Hashes of six words that meet by chance only keep words that the trees then look at in vain.
    """
    at = np.arange(len(words))
    spread = words.astype(np.uint64) * _MIX[_GRAM]
    spread ^= spread >> np.uint64(29)
    while len(at) >= LEAST:
        size = len(at) - _GRAM + 1
        gram = part[:size].astype(np.uint64) * _MIX[0]
        for k in range(_GRAM):
            gram += (spread[at[k:size + k]] ^ (spread[at[k:size + k]] >> np.uint64(31))) * _MIX[k]
        whole = part[:size] == part[_GRAM - 1:]
        order = np.argsort(gram, kind="stable")
        equal = (gram[order[1:]] == gram[order[:-1]]) & (part[order[1:]] == part[order[:-1]])
        again = np.zeros(size + 1, bool)
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
        marks = np.zeros(len(at) + 1, np.int64)
        begins = np.flatnonzero(again[:size] & whole)
        marks[begins] += 1
        marks[begins + _GRAM] -= 1
        covered = np.cumsum(marks[:-1]) > 0
        # what is left falls into new parts, each an unbroken stretch
        kept, old = at[covered], part[covered]
        if not len(kept):
            return []
        new = np.concatenate(([True], (np.diff(kept) != 1) | (old[1:] != old[:-1])))
        number = np.cumsum(new) - 1
        long = np.bincount(number)[number] >= LEAST
        kept, fresh = kept[long], number[long]
        if len(kept) == len(at):
            edges = np.flatnonzero(np.concatenate(([True], fresh[1:] != fresh[:-1], [True])))
            return [(int(kept[a]), int(kept[b - 1]) + 1) for a, b in zip(edges, edges[1:])]
        at, part = kept, fresh
    return []


def _found(texts: list[bytes], least: int) -> list[tuple[list[bytes], np.ndarray]]:
    """Words and runs of each text."""
    known: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    sizes = [len(w) for w in split]
    begins = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, begins[-1])
    runs: dict[int, list[np.ndarray]] = {}
    stretches = possible(ids, np.repeat(np.arange(len(texts)), sizes))
    for begin, end in stretches:
        doc = int(np.searchsorted(begins, begin, side="right")) - 1
        own = runs_of(ids[begin:end], least)
        own[:, 0] += begin - begins[doc]
        runs.setdefault(doc, []).append(own)
    none = np.empty((0, 3), np.int64)
    return [(words, np.concatenate(runs[k]) if k in runs else none) for k, words in enumerate(split)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stand in no run beyond its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(marks[:-1]) == 0)])


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``row, n_words, runs, collapsed``: the row of ``docs`` with the runs of its words and its text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0; ``runs`` holds ``start, length, period`` in words, by start and
    period. ``collapsed`` joins by one space the words that no run holds after its first period. Null and empty texts
    have no words and no runs; repeated rows give repeated results; an empty table gives none. Each text is taken alone,
    whole, and rows are not shuffled; memory is some hundred bytes per word of a stretch that repeats itself.
    """
    if least < 2 * _GRAM:
        raise ValueError(f"the shortest run has {2 * _GRAM} words or more")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, words = 0, 0
            bodies = batch.column("body")
            lengths = pa.compute.binary_length(bodies).to_numpy(zero_copy_only=False)
            for k in range(len(bodies)):
                words += int(lengths[k]) // 4
                if words >= _AT_ONCE or k + 1 == len(bodies):
                    yield answer(batch.slice(begin, k + 1 - begin))
                    begin, words = k + 1, 0

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _found(batch.column("body").cast(pa.binary()).to_pylist(), least)
        ends = np.concatenate(([0], np.cumsum([len(r) for _, r in found]))).astype(np.int32)
        flat = np.concatenate([r for _, r in found]) if found else np.empty((0, 3), np.int64)
        runs = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array([len(w) for w, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), runs),
             pa.array([collapse(w, r) for w, r in found], pa.binary()).cast(pa.string())], ["row", "n_words", "runs", "collapsed"])

    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row") if len(docs.columns) > 1
                       else F.struct(F.lit(0).alias("none")).alias("row"), as_text(F.col(text)).alias("body"))
    kind = seen.schema["row"].dataType.simpleString()
    return seen.mapInArrow(find, f"row {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
