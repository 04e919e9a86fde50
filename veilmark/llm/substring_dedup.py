"""Substring dedup by repeated-phrase automata.

1. Each window of ``window`` words picks its least-hashed phrase of ``phrase`` words, so equal windows pick equal phrases.
   A phrase picked at two places or more, in whatever documents, is confirmed as a part of a recurring passage.
2. Documents are dealt to shards of about ``SHARD`` bytes of text, and confirmed phrases to the shards that picked them. A
   shard's phrases are compiled into one Aho-Corasick automaton, and all documents of the shard are streamed through it. It
   finds every occurrence by the bytes of the text, also where no window picked the phrase. Places that were picked serve to
   read a phrase's text once, and are then forgotten.
3. Windows that hold an occurrence can recur, and no others can; those whose 96-bit hash starts at two places or more do.
   Both parts of the hash come from independent hashes of the words.
4. Words that a recurring window covers go.

Phrases and windows are counted by ranges of their hash. What occurs twice within a task's share is known to recur there and
then; it is sent on once, so that a passage in a third of all documents costs one entry a share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.hashing import Words, ngram_hashes, slices, text_bytes, words
from veilmark.llm.worker import claim
from veilmark.scratch import cut

WINDOW, PHRASE = 35, 8
#: Bytes of text that share an automaton, and that are counted together before entries are sent on.
SHARD, SHARE = 2 << 20, 16 << 20
#: Rows with a text and without an id that may share a shard, if they are alike.
NAMELESS = 1000
#: Entries that a bucket holds before those of one key are folded.
HELD = 2_000_000
_ENTRY = "bucket long, n long, blob binary"


class Kind:
    """What is counted: keys (one or two parts of a hash) at places (columns), and how both are packed."""

    def __init__(self, keys: list, places: dict):
        self.keys, self.places = keys, places
        self.types = [*keys, *places.values(), np.uint8]

    def pack(self, keys: list[np.ndarray], places: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, bytes]]:
        """Blobs (bucket, entries, bytes): keys once each with one place and whether they occur again; n < 0: places of keys that do."""
        if not len(keys[0]):
            return
        order = np.lexsort(keys[::-1])
        keys, places = [k[order] for k in keys], [p[order] for p in places]
        starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        times = np.diff(np.append(starts, len(order)))
        many = (times > 1).astype(np.uint8)
        where = (keys[0][starts] >> np.uint64(64 - 20)).astype(np.int64) * buckets >> 20
        used, at = np.unique(where, return_index=True)
        for u, i, j in zip(used.tolist(), at.tolist(), [*at[1:].tolist(), len(starts)]):
            by = np.lexsort([p[starts[i:j]] for p in places[::-1]])  # places side by side compress
            s, flags = starts[i:j][by], many[i:j][by]
            yield u, j - i, b"".join([c[s].tobytes() for c in (*keys, *places)] + [flags.tobytes()])
        known = np.repeat(times > 1, times)
        if known.any():
            keep = [k[known] for k in self.settled(keys, places)]
            deal = keep[0] % buckets
            order = np.lexsort([*keep[::-1], deal])
            keep, deal = [k[order] for k in keep], deal[order]
            used, at = np.unique(deal, return_index=True)
            for u, i, j in zip(used.tolist(), at.tolist(), [*at[1:].tolist(), len(deal)]):
                yield u, i - j, b"".join([k[i:j].tobytes() for k in keep])

    def settled(self, keys: list[np.ndarray], places: list[np.ndarray]) -> list[np.ndarray]:
        """What is said of a place whose key recurs: the place, and the key if it is short."""
        return [*places, *keys] if len(keys) == 1 else places

    def recurring(self):
        """Places of keys that occur twice or more, from buckets that come one after another."""
        settled = [*self.places.values(), *(self.keys if len(self.keys) == 1 else [])]
        names, n_keys = [*self.places, *(["h"] if len(self.keys) == 1 else [])], len(self.keys)

        def table(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)

        def split(blob: bytes, n: int, types: list) -> list[np.ndarray]:
            out, lo = [], 0
            for t in types:
                size = n * np.dtype(t).itemsize
                out.append(np.frombuffer(blob[lo : lo + size], t))
                lo += size
            return out

        def fold(held: list[list[np.ndarray]]) -> tuple[list[np.ndarray], pa.RecordBatch]:
            """One entry for each key, flagged if it occurs again, and the places that this settles."""
            e = [np.concatenate(c) for c in zip(*held)]
            order = np.lexsort(e[:n_keys][::-1])
            e = [c[order] for c in e]
            starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in e[:n_keys]], axis=0)]))
            times = np.diff(np.append(starts, len(order)))
            # an entry that is flagged was settled where it came from
            found = np.repeat(times > 1, times) & (e[-1] == 0)
            out = table([c[found] for c in self.settled(e[:n_keys], e[n_keys:-1])])
            left = [c[starts] for c in e]
            left[-1] = left[-1] | (times > 1)
            return left, out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("repeats")
            bucket, held, size = None, [], 0
            for b in batches:
                for w, k, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "n", "blob"))):
                    if k < 0:
                        yield table(split(blob, -k, settled))
                        continue
                    if held and (w != bucket or size > HELD):
                        left, out = fold(held)
                        yield out
                        held, size = ([], 0) if w != bucket else ([left], len(left[0]) // 2)
                    bucket = w
                    held.append(split(blob, k, self.types))
                    size += k
            if held:
                yield fold(held)[1]

        return run


PHRASES = Kind([np.uint64], {"shard": np.int32})
WINDOWS = Kind([np.uint64, np.uint32], {"shard": np.int32, "place": np.int64})


def _packed(blobs: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, n, data = zip(*blobs) if (blobs := list(blobs)) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "n", "blob"])


def picks(w: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, at, hashes): first words of all windows and of the phrases that each picks, and the hashes of all phrases by
    their first word; of equal hashes in a window the leftmost is picked."""
    grams = ngram_hashes(w.hash, phrase)
    wide = window - phrase + 1
    if len(grams) < wide:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    chosen = np.empty(len(grams) - wide + 1, np.int64)
    for lo in range(0, len(chosen), 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(grams[lo : lo + (1 << 16) + wide - 1], wide)
        chosen[lo : lo + len(view)] = lo + np.arange(len(view)) + view.argmin(axis=1)
    whole = np.zeros(len(chosen) + 1, np.int64)
    starts, ends = w.of_doc[:-1], w.of_doc[1:] - window + 1
    some = ends > starts
    np.add.at(whole, starts[some], 1)
    np.add.at(whole, ends[some], -1)
    start = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    return start, chosen[start], grams


def _phrases(window: int, phrase: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats")
        hashes, shards, size = [], [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                raw, ends = text_bytes(b.column("text"))
                w = words(raw, ends)
                _, at, grams = picks(w, window, phrase)
                at = np.unique(at)
                hashes.append(grams[at])
                shards.append(np.asarray(b.column("shard"))[np.searchsorted(w.of_doc, at, side="right") - 1])
                size += len(raw)
                if size > SHARE:
                    yield _packed(PHRASES.pack([np.concatenate(hashes)], [np.concatenate(shards)], buckets))
                    hashes, shards, size = [], [], 0
        if hashes:
            yield _packed(PHRASES.pack([np.concatenate(hashes)], [np.concatenate(shards)], buckets))

    return run


def occurrences(raw: np.ndarray, w: Words, phrases: np.ndarray, phrase: int) -> np.ndarray:
    """First words of every occurrence, in all these documents, of the phrases whose text begins at words ``phrases``.

    Every word is written with one blank after it and every document with a line feed before it, so phrases meet whole words
    of one document only. Bytes are taken as characters one by one."""
    size = (w.end - w.start).astype(np.int64)
    newline = np.zeros(len(w) + 1, np.int64)
    np.add.at(newline, w.of_doc[:-1], 1)
    newline = newline[:-1]  # line feeds before each word
    at = np.cumsum(size + 1 + newline) - size - 1  # where each word is written
    text = np.full(int(at[-1] + size[-1] + 1) if len(w) else 0, 0x0A, np.uint8)
    if len(w):
        text[at + size] = 0x20
        owner = np.repeat(np.arange(len(w), dtype=np.int32), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        text[at[owner] + inside] = raw[w.start[owner] + inside]
    letters = text.tobytes().decode("latin-1")
    automaton = ahocorasick.Automaton()
    stops = at + size + 1
    for i in phrases.tolist():
        found = letters[at[i] : stops[i + phrase - 1]]
        automaton.add_word(found, len(found))
    if not len(automaton):
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    begins = np.fromiter((e + 1 - k for e, k in automaton.iter(letters)), np.int64)
    first = np.minimum(np.searchsorted(at, begins), len(w) - 1)
    return np.unique(first[at[first] == begins])  # a hit that begins inside a word is none


def _ordered(docs: pa.Table, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The order of a shard's rows by hash and text, and a number for each; rows alike in both share it."""
    key, text = docs.column("_row").to_pylist(), docs.column(text_col)
    text = [x or "" for x in text.to_pylist()]
    order = sorted(range(len(key)), key=lambda i: (key[i], text[i]))
    new = [not n or key[i] != key[order[n - 1]] or text[i] != text[order[n - 1]] for n, i in enumerate(order)]
    return np.array(order, np.int64), np.cumsum(new, dtype=np.int64) - 1


def _windows(text_col: str, window: int, phrase: int, buckets: int):
    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        if not len(docs) or not len(phrases):
            return pa.Table.from_batches([_packed(iter(()))])
        order, number = _ordered(docs, text_col)
        raw, ends = text_bytes(docs.column(text_col).take(pa.array(order)))
        w = words(raw, ends, keys=2)
        start, at, grams = picks(w, window, phrase)
        confirmed = np.unique(np.asarray(phrases.column("h")).view(np.uint64))
        own, first = np.unique(grams[at], return_index=True)
        hits = occurrences(raw, w, at[first[np.isin(own, confirmed)]], phrase)
        upto = np.searchsorted(hits, np.stack([start, start + window - phrase + 1]))
        start = start[upto[1] > upto[0]]
        doc = np.searchsorted(w.of_doc, start, side="right") - 1
        if not len(start):
            return pa.Table.from_batches([_packed(iter(()))])
        keys = [ngram_hashes(w.hashes[0], window, 1)[start], (ngram_hashes(w.hashes[1], window, 2)[start] >> np.uint64(32)).astype(np.uint32)]
        places = [np.full(len(start), docs.column("_shard")[0].as_py(), np.int32), number[doc] << 32 | start - w.of_doc[doc]]
        return pa.Table.from_batches([_packed(WINDOWS.pack(keys, places, buckets))])

    return run


def _without(cols: list[str], text_col: str, window: int):
    def run(docs: pa.Table, starts: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        place = np.unique(np.asarray(starts.column("place"))) if len(starts) else np.zeros(0, np.int64)
        order, number = _ordered(docs, text_col)
        of = np.empty(len(docs), np.int64)
        of[order] = number
        raw, at = text_bytes(docs.column(text_col))
        w = words(raw, at)
        data = raw.tobytes()
        count, gone, kept = np.diff(w.of_doc), np.zeros(len(docs), np.int64), []
        lows, highs = np.searchsorted(place, of << 32), np.searchsorted(place, of + 1 << 32)
        for i in range(len(docs)):
            lo, hi = int(w.of_doc[i]), int(w.of_doc[i + 1])
            start, end = w.start[lo:hi], w.end[lo:hi]
            if highs[i] > lows[i]:
                mark = np.zeros(hi - lo + 1, np.int64)
                s = place[lows[i] : highs[i]] & 0xFFFFFFFF
                np.add.at(mark, s, 1)
                np.add.at(mark, s + window, -1)
                stay = np.cumsum(mark[:-1]) == 0
                start, end = start[stay], end[stay]
            gone[i] = hi - lo - len(start)
            kept.append(b" ".join([data[x:y] for x, y in zip(start.tolist(), end.tolist())]).decode())
        return pa.table([*(docs.column(c) for c in cols), pa.array(count, pa.int64()), pa.array(gone), pa.array(kept, pa.string())], names=[*cols, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words, joined by one space, that no recurring window covers.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window recurs if its words start anywhere else, in the same text or another
    row's, rows that repeat id and text included. A null text has no words. An empty table gives no rows. Columns of these
    names in ``docs`` are replaced, as are those named _shard or _row. Rows alike in id and text share a shard; empty texts and
    rows without an id, which may be many alike, are dealt by their place. Where many have none, places are written down first."""
    if not 1 <= phrase <= window:
        raise ValueError("a phrase is a part of a window")
    cols = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", "_shard", "_row")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    total, nameless = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count_if(F.col(id_col).isNull() & (text != ""))).first()
    shards, buckets = max(1, -(-total // SHARD)), max(8, 1 << math.ceil(math.log2(max(1, total / (4 * SHARD)))))
    row = F.xxhash64(F.col(id_col), text)
    apart = text == ""
    if nameless > NAMELESS:
        apart |= F.col(id_col).isNull()
    shard = F.pmod(F.when(apart, F.xxhash64(F.monotonically_increasing_id())).otherwise(row), F.lit(shards)).cast("int")
    keyed = docs.select(*cols, row.alias("_row"), shard.alias("_shard"))
    if nameless > NAMELESS:  # both passes must find a row at the same place
        keyed = cut(keyed)
    deal = lambda df, kind, out: df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(kind.recurring(), out)
    found = keyed.select(F.col("_shard").alias("shard"), F.col(text_col).alias("text")).mapInArrow(_phrases(window, phrase, buckets), _ENTRY)
    phrases = deal(found, PHRASES, "shard int, h long")
    #: the documents are shuffled once: both cogroups read the same exchange
    by_shard = keyed.groupBy("_shard")
    entries = by_shard.cogroup(phrases.groupBy("shard")).applyInArrow(_windows(text_col, window, phrase, buckets), _ENTRY)
    starts = deal(entries, WINDOWS, "shard int, place long")
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in cols)
    return by_shard.cogroup(starts.groupBy("shard")).applyInArrow(_without(cols, text_col, window), f"{kinds}n_words long, n_removed long, kept string")
