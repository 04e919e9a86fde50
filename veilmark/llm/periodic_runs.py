"""Runs of repeating words, found by internal pattern matching.

A run is a stretch of words whose smallest period is ``q`` (words ``q`` apart are the same), at least ``EXPONENT * q`` and
``SHORTEST`` words long, which no neighbouring word extends.

1. Blocks of 4, 8, 16, ... words begin at every half of their length. A run of period ``q`` holds a block of ``m`` words with
   ``m / 2 <= q < m`` (``q < 4`` at the first level) near its start, and the same words ``q`` further on.
2. Suffixes are sorted by prefix doubling, so that the occurrences of a block are an interval of the suffix array; those of
   which no other has the same first four words in the document can be no block's occurrence and are left out. A wavelet tree
   over the array gives, for an interval, the first place at or after another (range successor).
3. Each block asks for its occurrences in the window ``[m / 2, m)`` ahead. Up to two give a candidate period each; three or
   more are one arithmetic progression, whose difference is the block's own period. The stretch of that period breaks off at
   the block and again at the progression; the distance of these ends is the only candidate.
4. Longest common extensions to both sides (prefix hashes, halving steps) make candidates runs; these are then compared word
   for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.hashing import mix, ngram_hashes, slices, text_bytes, words
from veilmark.llm.worker import claim

EXPONENT, SHORTEST = 4, 6
#: Words of the least block.
_BLOCK = 4
_ODD = np.uint64(0x9FB21C651E98DF25)


class WaveletTree:
    """Rank structures over a list of numbers, bit by bit from the highest; all queries take arrays."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.int64)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            packed = np.zeros((len(values) // 64 + 1) * 8, np.uint8)
            bits = np.packbits(one, bitorder="little")
            packed[: len(bits)] = bits
            word = packed.view("<u8")
            self.words.append(word)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)]))
            self.zeros.append(len(values) - int(one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        part = self.words[level][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[level][at] + np.bitwise_count(part)

    def below(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many of the numbers at ``lo`` to ``hi`` are less than ``v``."""
        above = v >> self.bits > 0
        out = np.where(above, hi - lo, 0)
        for level in range(self.bits):
            l1, h1 = self._ones(level, lo), self._ones(level, hi)
            one = v >> (self.bits - 1 - level) & 1 == 1
            out = out + np.where(one & ~above, hi - h1 - (lo - l1), 0)
            lo, hi = np.where(one, self.zeros[level] + l1, lo - l1), np.where(one, self.zeros[level] + h1, hi - h1)
        return out

    def smallest(self, lo: np.ndarray, hi: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The number at ``lo`` to ``hi`` that ``r`` of them precede in order."""
        out = np.zeros(len(r), np.int64)
        for level in range(self.bits):
            l1, h1 = self._ones(level, lo), self._ones(level, hi)
            zeros = hi - h1 - (lo - l1)
            one = r >= zeros
            out = out << 1 | one
            r = np.where(one, r - zeros, r)
            lo, hi = np.where(one, self.zeros[level] + l1, lo - l1), np.where(one, self.zeros[level] + h1, hi - h1)
        return out


class Extensions:
    """How far the words from two places on, or before them, are the same, within their document; first places are smaller."""

    def __init__(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.begin, self.end = begin, end
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(h), _ODD), dtype=np.uint64)])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * self.power[:-1], dtype=np.uint64)])

    def _same(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[x + size] - self.sums[x]) * self.power[y - x] == self.sums[y + size] - self.sums[y]

    def _most(self, most: np.ndarray, same) -> np.ndarray:
        got = np.zeros(len(most), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            try_ = got + step
            ok = try_ <= most
            ok[ok] = same(np.flatnonzero(ok), try_[ok])
            got = np.where(ok, try_, got)
            step >>= 1
        return got

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._most(self.end[y - 1] - y, lambda i, size: self._same(x[i], y[i], size))

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._most(x - self.begin[x], lambda i, size: self._same(x[i] - size, y[i] - size, size))


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Numbers by the order of ``keys``, which ``order`` sorts; equal keys get equal numbers."""
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _candidates(h: np.ndarray, of_doc: np.ndarray, begin: np.ndarray, end: np.ndarray, ahead: Extensions) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): periods of four and more repeats can only be these, at these places."""
    none = np.zeros(0, np.int64)
    if len(h) < SHORTEST:
        return none, none
    grams = ngram_hashes(h, _BLOCK)
    at = np.flatnonzero(np.arange(len(grams)) + _BLOCK <= end[: len(grams)])
    doc = np.searchsorted(of_doc, at, side="right").astype(np.uint64)
    key = mix(grams[at] ^ mix(doc))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return none, none
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    some = twice[place] == key
    at, rank = at[some], place[some]
    # prefix doubling: names of blocks, and the suffix array that refines them all
    name = np.full(len(h), -1, np.int64)
    name[at] = rank
    size, longest, levels = _BLOCK, int((end - begin).max()), []
    while True:
        here = name[at]
        ordered = np.sort(rank)
        block = np.flatnonzero((here >= 0) & ((at - begin[at]) % (size // 2) == 0))
        levels.append((size, at[block], np.searchsorted(ordered, rank[block]), np.searchsorted(ordered, rank[block], side="right")))
        if size * 2 > longest // 2 or not len(block):
            break
        follows = at + size
        known = (here >= 0) & (follows < end[at])
        then = np.full(len(at), -1, np.int64)
        then[known] = name[follows[known]]
        order = np.lexsort((then, rank))
        rank = _dense(order, rank, then)
        times = np.bincount(rank)
        name = np.full(len(h), -1, np.int64)
        name[at] = np.where((then >= 0) & (times[rank] > 1), rank, -1)
        size *= 2
    array = np.argsort(rank, kind="stable")
    tree = WaveletTree(array)
    places, periods = [none], [none]
    for size, p, lo, hi in levels:
        if not len(p):
            continue
        first, last = (1, _BLOCK - 1) if size == _BLOCK else (size // 2, size - 1)
        before, upto = tree.below(lo, hi, np.searchsorted(at, p + first)), tree.below(lo, hi, np.searchsorted(at, p + last + 1))
        n = upto - before
        nth = lambda k, some: at[tree.smallest(lo[some], hi[some], before[some] + k)]
        many = n >= 3 if size > _BLOCK else np.zeros(len(n), bool)
        for k in range(3):
            some = np.flatnonzero((n > k) & ~many)
            places.append(p[some])
            periods.append(nth(k, some) - p[some])
        some = np.flatnonzero(many)
        if len(some):
            a, b, own = nth(0, some), nth(1, some), p[some]
            step = b - a
            stops, goes = own + step + ahead.right(own, own + step), a + step + ahead.right(a, a + step)
            q = goes - stops
            ok = (q >= first) & (q <= last)
            places.append(own[ok])
            periods.append(q[ok])
    return np.concatenate(places), np.concatenate(periods)


def _as_is(h: np.ndarray, p: int, q: int, begin: int, end: int) -> tuple[int, int]:
    """The run of period ``q`` about ``p``, word by word."""
    lo, hi = p, p
    while hi + q < end and h[hi] == h[hi + q]:
        hi += 1
    while lo > begin and h[lo - 1] == h[lo - 1 + q]:
        lo -= 1
    return lo, hi + q - lo


def find_runs(h: np.ndarray, of_doc: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; ``h`` are the words' hashes, documents end to end."""
    count = np.diff(of_doc)
    begin, end = np.repeat(of_doc[:-1], count), np.repeat(of_doc[1:], count)
    ahead = Extensions(h, begin, end)
    p, q = _candidates(h, of_doc, begin, end, ahead)
    start = p - ahead.left(p, p + q)
    length = p + ahead.right(p, p + q) + q - start
    ok = length >= np.maximum(shortest, exponent * q)
    p, q, start, length = p[ok], q[ok], start[ok], length[ok]
    order = np.lexsort((p, q, length, start))
    p, q, start, length = p[order], q[order], start[order], length[order]
    if not len(p):
        return start, length, q
    # of one stretch the least period
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
    p, q, start, length = p[new], q[new], start[new], length[new]
    # word for word
    size = length - q
    x = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    same = np.add.reduceat(h[x] == h[x + np.repeat(q, size)], np.cumsum(size) - size) == size
    edge = lambda i, j, ok: ok & (h[np.clip(i, 0, len(h) - 1)] == h[np.clip(j, 0, len(h) - 1)])
    longer = edge(start - 1, start - 1 + q, start > begin[start]) | edge(start + length - q, start + length, start + length < end[start])
    for i in np.flatnonzero(~same | longer).tolist():
        start[i], length[i] = _as_is(h, int(p[i]), int(q[i]), int(begin[p[i]]), int(end[p[i]]))
    ok = length >= np.maximum(shortest, exponent * q)
    order = np.lexsort((q, start))
    order = order[ok[order]]
    return start[order], length[order], q[order]


def _collapsed(raw: np.ndarray, start: np.ndarray, end: np.ndarray, of_doc: np.ndarray, stay: np.ndarray) -> pa.Array:
    """Of each document the words that stay, joined by one space."""
    kept = np.flatnonzero(stay)
    upto = np.searchsorted(kept, of_doc)
    last = np.zeros(len(kept), bool)
    last[upto[1:][upto[1:] > upto[:-1]] - 1] = True
    size = (end[kept] - start[kept]).astype(np.int64)
    take = np.zeros(len(raw) + 1, np.int8)
    np.add.at(take, start[kept], 1)
    np.add.at(take, end[kept], -1)
    take = np.cumsum(take[:-1], dtype=np.int8).astype(bool)
    out = raw.copy()
    gap = end[kept][~last]  # a blank follows each word that isn't the last of those kept
    out[gap] = 0x20
    take[gap] = True
    sizes = np.concatenate([[0], np.cumsum(size + ~last)])
    return pa.Array.from_buffers(pa.large_string(), len(of_doc) - 1, [None, pa.py_buffer(sizes[upto].astype(np.int64)), pa.py_buffer(out[take])])


def _runs(text_col: str, exponent: int, shortest: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("runs")
        for whole in batches:
            for b in slices(whole, text_col):
                raw, ends = text_bytes(b.column(text_col))
                w = words(raw, ends)
                of_doc = w.of_doc.astype(np.int64)
                start, length, period = find_runs(w.hash, of_doc, exponent, shortest)
                doc = np.searchsorted(of_doc, start, side="right") - 1
                drop = np.zeros(len(w) + 1, np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                collapsed = _collapsed(raw, w.start, w.end, of_doc, np.cumsum(drop[:-1]) == 0)
                structs = pa.StructArray.from_arrays([pa.array(start - of_doc[doc]), pa.array(length), pa.array(period)], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)), pa.int32()), structs)
                columns = [b.column(c) for c in b.schema.names if c != text_col]
                names = [c for c in b.schema.names if c != text_col]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(of_doc)), lists, collapsed.cast(pa.string())], names=[*names, "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text_col: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``runs`` (start, length, period; by start and period) and ``collapsed``: the
    words, joined by one space, that no run contains after its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A null or empty text has no words, no runs and an empty string. Rows stand
    for themselves: repeated ones get equal results, and an empty table gives no rows. Columns named n_words, runs or collapsed
    are replaced. A text is worked on as a whole in one task, with about a hundred bytes of memory a word. The exponent is at
    least 4: below, the window of a block need not hold what the search relies on."""
    if exponent < EXPONENT or shortest < SHORTEST:
        raise ValueError("runs have four repeats and six words at least")
    cols = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed", text_col)]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in cols)
    out = f"{kinds}n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(*cols, F.col(text_col)).mapInArrow(_runs(text_col, exponent, shortest), out)
