"""What the operators' results must be, computed plainly over lists of rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lines(docs, min_docs=10, min_chars=1):
    key = lambda x: x.strip(BLANK).translate(UPPER)
    seen = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            seen[key(x)].add(d)
    out = []
    for d, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < min_chars or len(seen[key(x)]) < min_docs]
        out.append((d, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out


def warc(pages, min_bytes=0):
    first = {}
    for p, h in pages:
        x = (h or "").encode()
        if len(x) >= min_bytes and p is not None:
            first[x] = min(p, first.get(x, p))
    out = []
    for p, h in pages:
        x = (h or "").encode()
        leader = first.get(x)
        revisit = p is not None and leader is not None and leader != p
        out.append((p, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "revisit" if revisit else "response", leader if revisit else None))
    return out


def exact(docs, keep=max):
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    out = []
    for d, t in docs:
        g = groups[t or ""]
        best = keep((x for x in g if x is not None), default=None)
        out.append((d, best, len(g), d == best, sha(t or "")))
    return out


def targets(sizes: dict, weights=(1, 2, 3), most=3):
    """Water filling, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        share = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / share > most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / share for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        free -= set(over)
        left -= sum(out[s] for s in over)
    return out


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def similar(docs, n=5, percent=75):
    sets = {d: shingles(t, n) for d, t in docs}
    index = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            index[g].append(d)
    both = Counter()
    for d, s in sets.items():
        mine = Counter(o for g in s for o in index[g] if o > d)
        both |= {(d, o): k for o, k in mine.items()}
    links = [(a, b) for (a, b), k in both.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]
    c = components(sets, links)
    return [(d, len(s), c[d]) for d, s in sets.items()]


def vectors(rows, threshold=0.95):
    good = {i: np.array(v, np.float64) for i, v in rows if v and None not in v and np.isfinite(np.array(v, np.float64)).all() and np.any(v)}
    ids = list(good)
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids]) if ids else np.zeros((0, 1))
    m = x @ x.T >= threshold
    np.fill_diagonal(m, False)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(m)))]
    c = components([i for i, _ in rows], links)
    n = dict(zip(ids, m.sum(axis=1).tolist()))
    return [(i, n.get(i, 0), c[i], c[i] == i) for i, _ in rows]


def repeats(docs, window=35):
    texts = [(d, WORD.findall(t or "")) for d, t in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
