"""Word and n-gram hashes of whole batches of texts, computed on byte arrays.

A text is cut into words ``[^\\x20\\x09-\\x0D]+``. A word's 64-bit hash takes in its length and its bytes, eight at a time, with a
mixing step after each eight; no sum or product of bytes is involved, so words of regular patterns don't meet. Hashes of
another ``key`` are independent. They depend on the word's bytes alone, so they are the same in every task and on every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the temporary arrays of a step cover.
_PIECE = 1 << 18
#: Words of more bytes than this are hashed one by one.
_LONG = 256
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each begins, with the end last. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """hash: of each word, one array for each key; start, end: its bytes; of_doc: first word of each document, with the number
    of words last."""

    def __init__(self, hashes: list[np.ndarray], start: np.ndarray, end: np.ndarray, of_doc: np.ndarray):
        self.hashes, self.start, self.end, self.of_doc = hashes, start, end, of_doc

    @property
    def hash(self) -> np.ndarray:
        return self.hashes[0]

    def __len__(self) -> int:
        return len(self.start)


def _seed(key: int) -> np.uint64:
    return np.uint64((key + 1) * 0x9E3779B97F4A7C15 & _MASK)


def _hashed(part: np.ndarray, start: np.ndarray, end: np.ndarray, keys: int) -> list[np.ndarray]:
    """The hashes of the words at ``start`` to ``end`` of ``part``."""
    padded = np.concatenate([part, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(part) + 1,), "<u8", padded, strides=(1,))
    size = (end - start).astype(np.int64)
    out = [mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ _seed(k)) for k in range(keys)]
    long = np.flatnonzero(size > _LONG)
    rows, done = np.arange(len(start)), 0
    if len(long):
        rows = np.flatnonzero(size <= _LONG)
    while len(rows):
        lane = eight[start[rows] + done]
        left = np.minimum(size[rows] - done, 8)
        lane = lane & (np.uint64(_MASK) >> ((8 - left) * 8).astype(np.uint64))
        for h in out:
            h[rows] = mix(h[rows] ^ lane)
        done += 8
        rows = rows[size[rows] > done]
    for i in long.tolist():
        digest = hashlib.blake2b(part[start[i] : end[i]].tobytes(), digest_size=64).digest()
        for k, h in enumerate(out):
            h[i] = np.frombuffer(digest, "<u8")[k]
    return out


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False, keys: int = 1) -> Words:
    """The words of the texts that lie in ``raw`` at ``at``; with ``lower``, A-Z count as a-z. ``keys`` hashes of each, up to 8."""
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    starts, ends, hashes = [np.zeros(0, kind)], [np.zeros(0, kind)], [[np.zeros(0, np.uint64)] for _ in range(keys)]
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + _PIECE)
        while hi < len(raw):  # a piece ends where no word goes on
            ahead = np.flatnonzero(_SPACE[raw[hi : hi + 65536]] | first[hi : hi + 65536][: len(raw) - hi])
            if len(ahead):
                hi += int(ahead[0])
                break
            hi = min(len(raw), hi + 65536)
        part = LOWER[raw[lo:hi]] if lower else raw[lo:hi]
        is_word = ~_SPACE[part]
        edge = ~is_word[:-1] | first[lo + 1 : hi]
        begins, stops = is_word.copy(), is_word.copy()
        begins[1:] &= edge
        stops[:-1] &= ~is_word[1:] | first[lo + 1 : hi]
        start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        for known, h in zip(hashes, _hashed(part, start, end, keys)):
            known.append(h)
        starts.append((start + lo).astype(kind))
        ends.append((end + lo).astype(kind))
        lo = hi
    start = np.concatenate(starts)
    return Words([np.concatenate(h) for h in hashes], start, np.concatenate(ends), np.searchsorted(start, at))


def ngram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of every ``n`` consecutive words, by the place of the first; n-grams across documents are included.

    Up to 8 words are weighted and added; longer grams are mixed from two shorter ones, which may overlap."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    if n > 8:
        half = 8
        while half * 2 < n:
            half *= 2
        shorter = ngram_hashes(h, half, seed)
        last = len(h) - n + 1
        return mix(mix(shorter[:last] + np.uint64(n)) ^ shorter[n - half : n - half + last])
    step = pow(0xD1342543DE82EF95, 2 * seed + 1, 1 << 64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * np.uint64(pow(step, k + 1, 1 << 64))
    return mix(total + np.uint64(n * 0x632BE59BD9B4E019 + seed & _MASK))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in runs of about ``most`` bytes of text; a longer text is a run of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
