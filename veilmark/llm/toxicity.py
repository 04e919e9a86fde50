"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs. Each word gives a vector of its own, if it is in the vocabulary of the training sample, and the mean of the vectors of
its character pairs. Both are projected once for each distinct word of a batch. Windows of ``WINDOW`` words, each half over
the one before, cover every text to its end, so any ``STRIDE`` words in a row are whole in one of them; the network runs over
all windows of a batch at once and attention pools its states. A text's logit is that of its highest window, after a line
fitted on the sample (a longer text has more chances).

Fitting. At most ``SAMPLE`` labelled rows of each class, those with the least MD5 of their id, are collected; labels are known
for whole texts, so windows of toxic texts count as toxic at first and then only those the network itself finds so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.hashing import LOWER, slices, text_bytes, words
from veilmark.llm.worker import claim

#: Labelled rows of each class to learn from.
SAMPLE = 1000
#: Windows of one training text that a pass over the sample reads, evenly spread and others in each pass, so that a few very
#: long texts don't outweigh the rest; the passes that pick the toxic windows of a text, and scoring, read all of them.
TRAIN_WINDOWS = 24
WINDOW, STRIDE = 32, 16
#: Batches that a fit takes at least; small samples are gone through more often.
STEPS = 300
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_SLOTS = 8, 12, 8, 4096
VOCABULARY, MIN_DOCS = 8192, 3
_CHUNK = 1024

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(np.clip(-2 * x, -30, 30))) - 1


class Batch:
    """The distinct words of some texts and the windows over them."""

    def __init__(self, column: pa.Array, vocabulary: np.ndarray):
        raw, at = text_bytes(column)
        w = words(raw, at, lower=True)
        distinct, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
        self.word = word.astype(np.int32)
        place = np.minimum(np.searchsorted(vocabulary, distinct), max(len(vocabulary) - 1, 0))
        self.vocab = np.where(vocabulary[place] == distinct, place + 1, 0) if len(vocabulary) else np.zeros(len(distinct), np.int64)
        # character pairs of each distinct word, its ends included
        start, end = w.start[first], w.end[first]
        size = end - start
        lower = LOWER[raw]
        owner = np.repeat(np.arange(len(distinct), dtype=np.int32), size + 1)
        step = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(size + 1) - (size + 1)).astype(np.int32), size + 1)
        here = start[owner] + step
        a = np.where(step > 0, lower[np.maximum(here - 1, 0)] if len(raw) else 0, 0).astype(np.uint32)
        b = np.where(step < size[owner], lower[np.minimum(here, max(len(raw) - 1, 0))] if len(raw) else 0, 0).astype(np.uint32)
        self.pair = ((a * np.uint32(257) + b) * np.uint32(0x9E3779B1) >> np.uint32(20)).astype(np.int32)
        self.pairs = size + 1
        # windows: (first word, words) of each, and its document
        count = np.diff(w.of_doc)
        n = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, 1)
        self.doc = np.repeat(np.arange(len(count)), n)
        i = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)
        offset = np.minimum(i * STRIDE, np.maximum(count[self.doc] - WINDOW, 0))  # the last window ends with the text
        self.first, self.size = w.of_doc[:-1][self.doc] + offset, np.minimum(count[self.doc], WINDOW)
        self.n_docs, self.n_windows = len(count), n

    def inputs(self, p: Params, some: np.ndarray | None = None) -> np.ndarray:
        """The input vectors of the distinct words."""
        chars = np.add.reduceat(p["char"][self.pair], np.cumsum(self.pairs) - self.pairs, axis=0) if len(self.pairs) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([p["word"][self.vocab], chars / self.pairs[:, None].astype(np.float32)], axis=1)

    def steps(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, window) places of distinct words, and which of them are words."""
        t = np.arange(WINDOW)[:, None]
        real = t < self.size[windows][None, :]
        at = np.where(real, self.first[windows][None, :] + t, 0)
        return (self.word[at] if len(self.word) else np.zeros(at.shape, np.int32)), real


def init(n_words: int, seed: int = 7) -> Params:
    r = np.random.default_rng(seed)
    normal = lambda *shape, s=0.1: (r.standard_normal(shape) * s).astype(np.float32)
    size = WORD_DIM + CHAR_DIM
    p = {"word": normal(n_words + 1, WORD_DIM), "char": normal(CHAR_SLOTS, CHAR_DIM), "att": normal(2 * HIDDEN), "out": normal(2 * HIDDEN, s=0.3), "bias": np.zeros(1, np.float32)}
    p["word"][0] = 0
    for d in "fb":
        p |= {f"x{d}": normal(size, 3 * HIDDEN, s=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"z{d}": normal(HIDDEN, 2 * HIDDEN, s=0.3), f"c{d}": normal(HIDDEN, HIDDEN, s=0.3)}
    return p


def _run(g: np.ndarray, real: np.ndarray, p: Params, d: str, keep: list | None) -> np.ndarray:
    """States (time, window, HIDDEN) of one direction from projected inputs; where there is no word the state stays."""
    times = range(len(g)) if d == "f" else range(len(g) - 1, -1, -1)
    out = np.empty((*g.shape[:2], HIDDEN), np.float32)
    h = np.zeros((g.shape[1], HIDDEN), np.float32)
    full = real.all(axis=1)
    for t in times:
        gates = _sigmoid(g[t, :, : 2 * HIDDEN] + h @ p[f"z{d}"])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = _tanh(g[t, :, 2 * HIDDEN :] + (r * h) @ p[f"c{d}"])
        new = h + z * (c - h)
        if not full[t]:
            new = np.where(real[t][:, None], new, h)
        if keep is not None:
            keep.append((t, h, z, r, c))
        out[t] = h = new
    return out


def _pool(hf: np.ndarray, hb: np.ndarray, real: np.ndarray, p: Params):
    scores = np.where(real, hf @ p["att"][:HIDDEN] + hb @ p["att"][HIDDEN:], -1e9)
    scores[0] = np.where(real[0], scores[0], 0)  # a window without words
    weight = np.exp(scores - scores.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.concatenate([np.einsum("tb,tbh->bh", weight, hf), np.einsum("tb,tbh->bh", weight, hb)], axis=1)
    return weight, pooled


def window_logits(batch: Batch, p: Params) -> np.ndarray:
    x = batch.inputs(p)
    proj = {d: x @ p[f"x{d}"] + p[f"b{d}"] for d in "fb"}
    if not len(x):
        proj = {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}
    out = np.empty(len(batch.doc), np.float32)
    order = np.argsort(-batch.size, kind="stable")  # short windows lie together
    for lo in range(0, len(order), _CHUNK):
        some = order[lo : lo + _CHUNK]
        at, real = batch.steps(some)
        longest = max(1, int(batch.size[some].max()))
        at, real = at[:longest], real[:longest]
        hf, hb = (_run(proj[d][at], real, p, d, None) for d in "fb")
        out[some] = _pool(hf, hb, real, p)[1] @ p["out"] + p["bias"][0]
    return out


def _gradients(batch: Batch, some: np.ndarray, y: np.ndarray, weight: np.ndarray, p: Params) -> tuple[Params, np.ndarray]:
    at, real = batch.steps(some)
    used, inv = np.unique(at, return_inverse=True)
    inv = inv.reshape(at.shape)
    lengths = batch.pairs[used]
    begin = (np.cumsum(batch.pairs) - batch.pairs)[used]
    take = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    pair = batch.pair[take]
    owner = np.repeat(np.arange(len(used)), lengths)
    chars = np.add.reduceat(p["char"][pair], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None].astype(np.float32)
    x = np.concatenate([p["word"][batch.vocab[used]], chars], axis=1)
    kept: dict[str, list] = {"f": [], "b": []}
    hs = {d: _run((x @ p[f"x{d}"] + p[f"b{d}"])[inv], real, p, d, kept[d]) for d in "fb"}
    att, pooled = _pool(hs["f"], hs["b"], real, p)
    logit = pooled @ p["out"] + p["bias"][0]
    dl = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
    g: Params = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"], g["bias"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
    dpooled = dl[:, None] * p["out"]
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        part = slice(k * HIDDEN, (k + 1) * HIDDEN)
        h, dp = hs[d], dpooled[:, part]
        dscore = att * ((h - pooled[None, :, part]) * dp).sum(axis=2)
        # the softmax mixes both halves of a state, and its gradient is the sum of what each half gives
        for k2, d2 in enumerate("fb"):
            part2 = slice(k2 * HIDDEN, (k2 + 1) * HIDDEN)
            g["att"][part2] += np.einsum("tb,tbh->h", dscore, hs[d2])
        kept[d].append(dscore)
    dscore = kept["f"].pop() + kept["b"].pop()
    dscore *= real
    for k, d in enumerate("fb"):
        part = slice(k * HIDDEN, (k + 1) * HIDDEN)
        dproj = np.zeros((*at.shape, 3 * HIDDEN), np.float32)
        dh = np.zeros((at.shape[1], HIDDEN), np.float32)
        for t, h, z, r, c in reversed(kept[d]):
            dh = dh + att[t][:, None] * dpooled[:, part] + dscore[t][:, None] * p["att"][part]
            m = real[t][:, None]
            new = np.where(m, dh, 0)
            dz, dc = new * (c - h) * z * (1 - z), new * z * (1 - c * c)
            drh = dc @ p[f"c{d}"].T
            dr = drh * h * r * (1 - r)
            gates = np.concatenate([dz, dr], axis=1)
            g[f"z{d}"] += h.T @ gates
            g[f"c{d}"] += (r * h).T @ dc
            dproj[t] = np.concatenate([gates, dc], axis=1)
            dh = np.where(m, new * (1 - z) + gates @ p[f"z{d}"].T + drh * r, dh)
        flat, to = dproj.reshape(-1, 3 * HIDDEN), inv.ravel()
        summed = np.stack([np.bincount(to, flat[:, j], len(used)) for j in range(3 * HIDDEN)], axis=1).astype(np.float32)
        g[f"x{d}"], g[f"b{d}"] = x.T @ summed, summed.sum(axis=0)
        dx += summed @ p[f"x{d}"].T
    np.add.at(g["word"], batch.vocab[used], dx[:, :WORD_DIM])
    g["word"][0] = 0
    dchar = (dx[:, WORD_DIM:] / lengths[:, None].astype(np.float32))[owner]
    for j in range(CHAR_DIM):
        g["char"][:, j] = np.bincount(pair, dchar[:, j], CHAR_SLOTS)
    return g, logit


def _top(batch: Batch, logits: np.ndarray) -> np.ndarray:
    top = np.full(batch.n_docs, -np.inf)
    np.maximum.at(top, batch.doc, logits)
    return top


def fit(texts: list[str], labels: np.ndarray, share: float = 0.5, seed: int = 7, epochs: int = 5, rate: float = 0.01, size: int = 256) -> dict:
    """The network and its vocabulary, from whole texts and their labels (0 or 1).

    ``share``: what part of all labelled texts is toxic; the sample has its own, and scores are set for that of all."""
    column = pa.array(texts, pa.large_string())
    raw, at = text_bytes(column)
    w = words(raw, at, lower=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.of_doc))
    seen = np.unique(np.stack([w.hash, doc.astype(np.uint64)], axis=1), axis=0)[:, 0] if len(w) else np.zeros(0, np.uint64)
    found, docs = np.unique(seen, return_counts=True)
    least = max(MIN_DOCS, len(texts) // 200)
    found, docs = found[docs >= least], docs[docs >= least]
    vocabulary = np.sort(found[np.argsort(-docs, kind="stable")[:VOCABULARY]])
    p = init(len(vocabulary), seed)
    model = {"vocabulary": vocabulary, "params": p, "scale": 1.0, "shift": -10.0}
    labels = np.asarray(labels)
    if not len(texts) or labels.min() == labels.max():  # nothing to tell apart
        model["shift"] = 10.0 if len(texts) and labels.min() == 1 else -10.0
        model["scale"] = 0.0
        return model
    batch = Batch(column, vocabulary)
    r = np.random.default_rng(seed)
    i = np.arange(len(batch.doc)) - np.repeat(np.cumsum(batch.n_windows) - batch.n_windows, batch.n_windows)
    stride = np.maximum(1, -(-batch.n_windows // TRAIN_WINDOWS))[batch.doc]
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    # one text in five is not trained on but for the line from logits to scores, if both classes are there
    aside = np.arange(len(labels)) % 5 == 4
    if len(set(labels[aside])) < 2 or len(set(labels[~aside])) < 2:
        aside[:] = False
    trained = ~aside[batch.doc]
    n_train = int((i % stride == 0).sum())
    size = min(size, max(16, n_train // 40))
    epochs = max(epochs, -(-STEPS // max(1, n_train // size)))
    for epoch in range(epochs):
        use = (i + epoch) % stride == 0
        y = labels[batch.doc].astype(np.float32)
        if epoch >= 0.4 * epochs:  # of toxic texts, windows near the highest count as toxic and the others are left out
            logits = window_logits(batch, p)
            top = _top(batch, logits)[batch.doc]
            use = np.where(y > 0, (logits >= top - 1) | (logits > 2), use)
        some = np.flatnonzero(use & trained)
        part = max(1e-6, float(y[some].mean()))
        balance = np.where(y > 0, 0.5 / part, 0.5 / max(1e-6, 1 - part))
        r.shuffle(some)
        for lo in range(0, len(some), size):
            now = some[lo : lo + size]
            g, _ = _gradients(batch, now, y[now], balance[now], p)
            step += 1
            a = rate * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in p:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] * g[k] - m2[k])
                if k in ("word", "char"):
                    p[k] *= np.float32(1 - 0.05 * a)
                p[k] -= (a * m1[k] / (np.sqrt(m2[k]) + 1e-8)).astype(np.float32)
    top = _top(batch, window_logits(batch, p)).astype(np.float64)
    if aside.any():
        top, labels = top[aside], labels[aside]
    each = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    # the line from a text's highest logit to its own, on a standard scale, kept from growing without end
    mean, spread = float(top.mean()), float(top.std()) or 1.0
    z, slope, base = (top - mean) / spread, 1.0, 0.0
    for _ in range(4000):
        e = each * (_sigmoid(slope * z + base) - labels) / each.sum()
        slope, base = slope - 0.5 * (float((e * z).sum()) + 0.001 * slope), base - 0.5 * float(e.sum())
    scale, shift = slope / spread, base - slope * mean / spread
    return model | {"scale": scale, "shift": shift}


def score_texts(column: pa.Array, model: dict) -> np.ndarray:
    batch = Batch(column, model["vocabulary"])
    out = _sigmoid(model["scale"] * _top(batch, window_logits(batch, model["params"])).astype(np.float64) + model["shift"])
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """crc32(id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(id, label) of the ids that may be learnt from; an id that is labelled both 0 and 1 counts as 1."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label): the texts of up to ``most`` ids of each class whose crc32(id as text) mod 5 is not 0.

    Of rows that repeat an id the least text is taken."""
    kept = learnable(labels, id_col, label_col)
    sample = None
    for y in (0, 1):
        part = kept.where(F.col("label") == y).orderBy(F.md5(F.col("id").cast("string")), "id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    #: the sample has at most 2 * most rows
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    return rows.groupBy("id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> dict:
    """Fits the network on ``training_rows``; without labels of both classes it scores all texts alike."""
    counts = dict(map(tuple, learnable(labels, id_col, label_col).groupBy("label").count().collect()))
    rows = sorted(training_rows(docs, labels, most, id_col, text_col, label_col).collect(), key=lambda x: (x["id"], x["text"]))
    return fit([x["text"] for x in rows], np.array([x["label"] for x in rows]), share=counts.get(1, 0) / max(1, sum(counts.values())), **how)


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1.

    Null texts are empty; a text without words is one window without words, which the network scores. Equal texts get equal
    scores whatever rows they lie beside, ids play no part. A column named as the score is replaced. An empty table gives no
    rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the constants above
    cols = [c for c in docs.columns if c != score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for whole in batches:
            for b in slices(whole, text_col):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(score_texts(b.column(text_col), shared.value), pa.float64())], names=[*cols, score_col])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in cols)
    return docs.select(*cols).mapInArrow(run, f"{kinds}`{score_col}` double")
