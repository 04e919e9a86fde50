"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder on an incremental UTF-8 machine.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours, encoded together, come
out as themselves. So each prefix of a piece has one last token, found by walking a trie of the vocabulary from every
boundary that can still matter. A state of the transducer is the set of those walks with the tokens on which they still
differ; tokens that all walks share are emitted. Walks are no longer than the longest token, which bounds the lookahead.
Transitions that are met again and again are made into states and kept, up to a limit; from one that isn't there yet, the
rest of the piece is followed through the machine as it is, longest arc first, to the piece's end.

Decoding. Tokens may end inside a character. The decoder's state is the bytes that are pending; of what it is fed at a time,
all before the last lead byte is certain, and a UTF-8 machine runs over the rest.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veilmark.llm.hashing import slices
from veilmark.llm.worker import claim

_ROOT = 0
_NEVER = 1 << 62
# Fixed value: the published pattern under which texts may be cut before spaces.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Times that a transition is met before it is made.
HOT = 12
#: What a task remembers, at most: states, whether tokens fit side by side, and pieces (twice, as those not met of late go).
STATES, FITS, PIECES = 50_000, 600_000, 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_tree(token: bytes, ranks: dict[bytes, int]) -> tuple:
    """How the textbook encoding puts ``token`` together, as (bytes, left, right); it takes the pair of least rank, leftmost first."""
    parts: list[tuple] = [(token[i : i + 1], None, None) for i in range(len(token))]
    found = [ranks.get(token[i : i + 2], _NEVER) for i in range(len(token) - 1)]
    while len(parts) > 1:
        i = found.index(min(found))
        parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i], parts[i + 1])]
        del found[i]
        if i:
            found[i - 1] = ranks.get(parts[i - 1][0] + parts[i][0], _NEVER)
        if i < len(found):
            found[i] = ranks.get(parts[i][0] + parts[i + 1][0], _NEVER)
    return parts[0]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.start = 1 + max(self.bytes_of, default=0)  # stands for no token yet
        self.kids: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, r in ranks.items():
            node = _ROOT
            for b in t:
                if (to := self.kids[node].get(b)) is None:
                    to = self.kids[node][b] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = r
        self.fits: dict[int, bool] = {}
        self.lefts: dict[int, list] = {}
        self.rights: dict[int, list] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; they are made again when met."""
        self.met: dict[int, int] = {}
        self.ids: dict[tuple, int] = {}
        self.walks: list[tuple] = []
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.state((((self.start,), _ROOT),))

    def state(self, walks: tuple) -> int:
        if (s := self.ids.get(walks)) is None:
            s = self.ids[walks] = len(self.walks)
            self.walks.append(walks)
        return s

    def edge(self, t: int, right: bool) -> list[tuple[bytes, int]]:
        """What token t was at its right (or left) end as it was merged, last first, and the rank at which each was taken up."""
        spines = self.rights if right else self.lefts
        if (spine := spines.get(t)) is None:
            part, taken, spine = merge_tree(self.bytes_of[t], self.ranks), _NEVER, []
            while part is not None:
                spine.append((part[0], taken))
                taken, part = self.ranks[part[0]], part[2 if right else 1]
            spines[t] = spine
        return spine

    def joins(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are the encoding of their bytes.

        They are not if, at some time, what lies left and right of the border merges before either side takes its own up;
        at equal ranks the leftmost pair goes first."""
        get = self.ranks.get
        ok = a == self.start or not any(x_taken > (r := get(x + y, _NEVER)) <= y_taken and r < _NEVER for x, x_taken in self.edge(a, True) for y, y_taken in self.edge(b, False))
        self.fits[a << 20 | b] = ok
        return ok

    def advance(self, s: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after ``byte`` and the tokens that are now certain. Walks go from the earliest border to the latest."""
        kids, token, fits = self.kids, self.token, self.fits
        walks, ended = [], None
        for path, node in self.walks[s]:
            if (to := kids[node].get(byte)) is None:
                continue
            if ended is None and (t := token[to]) >= 0:
                ok = fits.get(path[-1] << 20 | t)
                if self.joins(path[-1], t) if ok is None else ok:
                    ended = (*path, t)
            if kids[to]:
                walks.append((path, to))
        if ended is None:
            raise ValueError(f"the vocabulary can't encode byte {byte}")
        walks.append((ended, _ROOT))
        first = walks[0][0]
        same = len(first)
        for path, _ in walks:
            while path[:same] != first[:same]:
                same -= 1
        if same > 1:
            walks = [(path[same - 1 :], node) for path, node in walks]
        out = self.step[s << 8 | byte] = self.state(tuple(walks)), first[1:same]
        return out

    def follow(self, last: int, data: bytes) -> list[int]:
        """The tokens after ``last`` of what is left of a piece: the machine as it is before it is determinised, longest arc
        first; an arc that leads nowhere is taken back and not tried again."""
        kids, token, fits, size = self.kids, self.token, self.fits, len(data)
        out, ends, left, dead, end = [last], [0], [], set(), 0
        while end < size:
            if len(left) < len(out):  # tokens that begin here, and where they end, the longest last
                arcs, node, at = [], _ROOT, end
                while at < size:
                    if (node := kids[node].get(data[at], -1)) < 0:
                        break
                    at += 1
                    if (t := token[node]) >= 0:
                        arcs.append((t, at))
                left.append(arcs)
            else:
                arcs = left[-1]
            while arcs:
                t, to = arcs.pop()
                ok = fits.get(last << 20 | t)
                if (self.joins(last, t) if ok is None else ok) and (not dead or (t, to) not in dead):
                    out.append(t)
                    ends.append(to)
                    last, end = t, to
                    break
            else:
                if len(out) == 1:
                    raise ValueError("the vocabulary can't encode this piece")
                left.pop()
                dead.add((out.pop(), ends.pop()))
                last, end = out[-1], ends[-1]
        return out[1:]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.walks) > self.max_states:
            self.reset()
        if len(self.fits) > FITS:
            self.fits.clear()
        s, out = 0, []
        get = self.step.get
        for byte in piece:
            if (to := get(s << 8 | byte)) is None:
                n = self.met.get(key := s << 8 | byte, 0)
                if n < HOT:  # made only for what comes again
                    if len(self.met) > 4 * self.max_states:
                        self.met.clear()
                    self.met[key] = n + 1
                    certain = sum(map(len, map(self.bytes_of.__getitem__, out))) if out else 0
                    return out + self.follow(self.walks[s][0][0][0], piece[certain:] if certain else piece)
                to = self.advance(s, byte)
            s, certain = to
            if certain:
                out += certain
        return [*out, *self.walks[s][-1][0][1:]]


class Pieces(dict):
    """Piece of text to its ids as bytes (little-endian, 32 bits); of more than ``limit``, those not met of late go."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece) or self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids as bytes.

    Each match of the pattern is encoded by itself. Under ``SPACED`` a match has a space at its start or is white space alone,
    and white space gives its last character to what follows, if anything does. So a match ends before every space but one
    that has white space before it and white space or the text's end after it. Texts without such a space are cut before
    spaces and what lies between is looked up whole; others, and all texts under another pattern, are matched as they are."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = PIECES):
        #: White_Space is what \s means to the tokenizer's own engine; the regex module would add U+001C to U+001F
        same = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split = regex.compile(same).findall
        self.whole = re.compile(r"\s (?:\s|\Z)").search if pattern == SPACED else lambda text: True
        self.transducer = Transducer(ranks)
        self.pieces = Pieces(self.ids, limit)
        self.spaced = Pieces(self.after_blank, limit)

    def ids(self, piece: str) -> bytes:
        found = array("I", self.transducer.encode(piece.encode()))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def after_blank(self, part: str) -> bytes:
        first, *more = self.split(" " + part)
        if not more:
            return self.ids(first)
        head = self.spaced[first[1:]] if first[:1] == " " and len(first) > 1 else self.pieces[first]
        return head + b"".join(map(self.pieces.__getitem__, more))

    def matched(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def __call__(self, text: str) -> bytes:
        if self.whole(text):
            return self.matched(text)
        first, *parts = text.split(" ")
        return self.matched(first) + b"".join(map(self.spaced.__getitem__, parts))


#: of a lead byte: how many bytes follow, and the bounds of the first of them
_LEADS = {**{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, **{b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)}, **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}}
_LEADS |= {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}
#: bytes that go on with a character
_FOLLOWS = range(0x80, 0xC0)


def complete(pending: bytes, more: bytes) -> tuple[bytes, bytes]:
    """What of ``pending + more`` is certain, and the unfinished character that is left; bytes that can't be UTF-8 are certain."""
    data = pending + more
    i = 0
    while i < len(data):
        need, low, high = _LEADS.get(data[i], (0, 0, 0))
        j = 1
        while j <= need and i + j < len(data) and low <= data[i + j] <= high:
            low, high = 0x80, 0xBF
            j += 1
        if j <= need and i + j == len(data):
            return data[:i], data[i:]
        i += j
    return data, b""


class StreamDecoder:
    """Feeds on ids and gives bytes that never end inside a character, but for what ``flush`` gives.

    Whatever comes before the last lead byte is certain, so the machine runs on what follows it alone."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.pending = b""

    def feed(self, ids: Iterable[int]) -> bytes:
        data = self.pending + b"".join(map(self.bytes_of.__getitem__, ids))
        at = next((len(data) - k for k in (1, 2, 3) if k <= len(data) and data[-k] not in _FOLLOWS), len(data))
        whole, self.pending = complete(b"", data[at:])
        return data[:at] + whole if self.pending else data

    def flush(self) -> bytes:
        rest, self.pending = self.pending, b""
        return rest


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    encoder = Encoder(load_ranks(path), pattern)
    gc.freeze()  # the vocabulary stays; the collector need not walk it again and again
    gc.set_threshold(100_000, 50, 50)
    return encoder


@lru_cache(maxsize=2)
def _decoder(path: str) -> StreamDecoder:
    return StreamDecoder({r: t for t, r in load_ranks(path).items()})


def _forget() -> None:
    _encoder.cache_clear()
    _decoder.cache_clear()
    gc.unfreeze()


def _mapped(df: DataFrame, work, column: str, kind: str, by: str) -> DataFrame:
    """``df`` with ``column`` added (or replaced) by ``work`` of slices of a batch, cut by the size of column ``by``."""
    cols = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _forget)
        for whole in batches:
            for b in slices(whole, by):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), work(b)], names=[*cols, column])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in cols)
    return df.select(*df.columns).mapInArrow(run, f"{kinds}`{column}` {kind}")


def _decoded(machine: StreamDecoder, ids: bytes, chunk: int) -> bytes:
    numbers = np.frombuffer(ids, "<u4").tolist()
    return b"".join([machine.feed(numbers[i : i + chunk]) for i in range(0, len(numbers), chunk)]) + machine.flush()


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text, as little-endian 32-bit integers end to end.

    ``path``, a file of ranks, must be there on every executor. Matches of ``pattern`` are encoded one by one. Null and empty
    texts have no ids. Each row, repeated ones too, gives one row, and an empty table none; a column of the name ``ids_col``
    is replaced and all others stay."""

    def work(b: pa.RecordBatch) -> pa.Array:
        encoder = _encoder(path, pattern)
        return pa.array([encoder(t) if t else b"" for t in (x.as_py() for x in b.column(text_col))], pa.binary())

    return _mapped(docs, work, ids_col, "binary", text_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded", chunk: int = 4096) -> DataFrame:
    """``df`` with the bytes that the ids stand for, decoded ``chunk`` ids at a time; null ids have none.

    Each row gives one row, and an empty table none; a column of the name ``bytes_col`` is replaced and all others stay."""

    def work(b: pa.RecordBatch) -> pa.Array:
        machine = _decoder(path)
        return pa.array([_decoded(machine, x.as_py() or b"", chunk) for x in b.column(ids_col)], pa.binary())

    return _mapped(df, work, bytes_col, "binary", ids_col)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = 4096) -> DataFrame:
    """``docs`` with ids, n_tokens, ids_sha256 and decoded_sha256 instead of the text: encoded, decoded again and digested
    (lowercase hex) in one pass, so that neither texts nor decoded bytes go out of a task. Rows and nulls as in ``encode``;
    columns of these names are replaced."""
    own = {"ids": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    cols = [c for c in docs.columns if c != text_col and c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _forget)
        encoder, machine = _encoder(path, pattern), _decoder(path)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for whole in batches:
            for b in slices(whole, text_col):
                ids = [encoder(t) if t else b"" for t in (x.as_py() for x in b.column(text_col))]
                made = [ids, [len(x) // 4 for x in ids], [digest(x) for x in ids], [digest(_decoded(machine, x, chunk)) for x in ids]]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), *(pa.array(v, k) for v, k in zip(made, own.values()))], names=[*cols, *own])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in cols)
    return docs.select(*cols, text_col).mapInArrow(run, f"{kinds}ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
