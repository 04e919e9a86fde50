"""Exact Jaccard join on word n-gram sets: size-banded tiles, hashed bitmap signatures, then sorted-array intersection.

1. Every document's set is hashed to sorted 64-bit numbers; equal sets are folded to one representative.
2. Two sets that are similar enough share a number in their prefixes under any one order of all numbers. The order puts
   numbers that many documents have last. These are found by counting within runs of documents: a number that more than one
   document in ``RUN_DOCS / 2`` has is in over two documents of some run. They are marked in a bitset of fixed size; a
   false mark changes the order, not the result.
3. Prefix entries travel as packed arrays by ranges of the hash. Entries of a marked number are folded to one a task before.
   Small groups give pairs, which sizes and prefix positions prune, each where a run of common numbers begins in both prefixes;
   large groups give chains in the order of size, which are cut where the next size is out of reach.
4. Pairs are bounded from above by the bit counts of the two signatures. What chains and the pairs that are left connect is
   cut into tiles: size bands, as only sets whose sizes are within the threshold can be similar, each dealt into blocks of
   bounded rows and numbers. Tiles of signatures bound all pairs by bit counts, each pair at the width of its shorter
   signature; what these leave connected goes into tiles again, where sorted arrays are intersected exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.hashing import mix, ngram_hashes, slices, text_bytes, words
from veilmark.llm.worker import claim
from veilmark.operators.components import connected_components
from veilmark.operators.skew import join_counted
from veilmark.scratch import cut

RUN_DOCS = 2048
MARK_BITS = 24
#: Numbers in more documents than one part in ``GROUP_PARTS`` of all are handled by tiles; in fewer, by pairs. The limit is
#: ``GROUP`` at least and ``MOST_GROUP`` at most, so an entry is in no more pairs than that.
GROUP, GROUP_PARTS, MOST_GROUP = 16, 4096, 1024
#: Pairs of a bucket that are made before sizes and places prune them.
MADE = 1 << 18
#: Numbers of the sets in a block: of a tile of arrays, 16 MB, and of a tile of signatures, 1 MB; at least one document.
BLOCK, SIGNED_BLOCK = 2 << 20, 4 << 20
#: Documents of a block.
BLOCK_ROWS = 2048
_SHORT = np.uint64(0xA24BAED4963EE407)


def sets_of(column: pa.Array, n: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; of a text with fewer words, the hash of all of them."""
    raw, at = text_bytes(column)
    w = words(raw, at, lower=lower)
    grams = ngram_hashes(w.hash, n)
    out = []
    for lo, hi in zip(w.of_doc[:-1].tolist(), w.of_doc[1:].tolist()):
        if hi - lo >= n:
            s = np.sort(grams[lo : hi - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif hi > lo:
            out.append(ngram_hashes(w.hash[lo:hi], hi - lo, seed=hi - lo) ^ _SHORT)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> bytes:
    """A bitmap with a bit for each number of the set, of about twice as many bits."""
    bits = min(1 << 20, max(64, 1 << (2 * len(s) - 1).bit_length()))
    m = np.zeros(bits, bool)
    m[mix(s) & np.uint64(bits - 1)] = True
    return np.packbits(m, bitorder="little").tobytes()


def fold(sig: np.ndarray, size: int) -> np.ndarray:
    while len(sig) > size:
        sig = sig[: len(sig) // 2] | sig[len(sig) // 2 :]
    return sig


def bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """No more numbers than this are in both sets: each bit that only one has is a number that only it has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = int.from_bytes(fold(x, size).tobytes(), "little"), int.from_bytes(fold(y, size).tobytes(), "little")
    return min(n_a - (x & ~y).bit_count(), n_b - (y & ~x).bit_count())


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers are in both of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


class Similarity:
    """Jaccard similarity of at least ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def enough(self, both, n_a, n_b):
        return 100 * both >= self.percent * (n_a + n_b - both)

    @property
    def step(self) -> float:
        """Width of a band, of which sizes that can be similar lie in the same or two side by side, in logarithms."""
        return math.log(100 / self.percent) if self.percent < 100 else 1e-6

    def band(self, n):
        return np.floor(np.log(n) / self.step + 1e-9)

    def sizes_fit(self, n_a, n_b):
        return 100 * np.minimum(n_a, n_b) >= self.percent * np.maximum(n_a, n_b)


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams")
        run_sets: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            every = np.sort(np.concatenate(run_sets)) if run_sets else np.zeros(0, np.uint64)
            run_sets.clear()
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(every)))
            h, times = every[starts][times > 2], times[times > 2]
            k = len(h)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(times, pa.int64()), pa.array(h.view(np.int64)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)

        names = ["doc", "n", "h", "print", "sig"]
        for whole in batches:
            for b in slices(whole, "text"):
                sets = sets_of(b.column("text"), n)
                size = np.array([len(s) for s in sets], np.int64)
                prints = [np.array([np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s ^ _SHORT))], np.uint64).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(size), pa.nulls(len(sets), pa.int64()), pa.array(prints, pa.binary()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())], names=names)
                run_sets += sets
                if len(run_sets) >= RUN_DOCS:
                    yield counted()
        yield counted()

    return run


def _entries(n: int, sim: Similarity, marks, buckets: int):
    """Prefix entries (number, doc, size, place, the number before) of a task by bucket, and stars between documents that share a marked number."""
    shift = np.uint64(64 - int(math.log2(buckets))) if buckets > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams")
        marked = np.frombuffer(marks.value, np.uint8)
        first: dict[tuple, tuple[int, int]] = {}  # of each marked number and band met, the entry that stands for the task's others

        def packed(h, *values) -> pa.RecordBatch:
            where = (h >> shift).astype(np.int64) if shift is not None else np.zeros(len(h), np.int64)
            order = np.argsort(where, kind="stable")
            where, columns = where[order], [x[order] for x in (h, *values)]
            used, at = np.unique(where, return_index=True)
            ends = np.append(at[1:], len(where))
            blobs = [b"".join(x[i:j].tobytes() for x in columns) for i, j in zip(at, ends)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(ends - at, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "n", "blob"])

        for whole in batches:
            for b in slices(whole, "text"):
                hs, ds, ss, ps, bs = [], [], [], [], []
                stars: set[tuple[int, int]] = set()
                for doc, s in zip(b.column("doc").to_pylist(), sets_of(b.column("text"), n)):
                    if not len(s):
                        continue
                    slot = (mix(s) >> np.uint64(64 - MARK_BITS)).astype(np.int64)
                    often = (marked[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                    rare, length = s[~often], sim.prefix(len(s))
                    h = rare[:length]
                    if len(h) < length:
                        band = int(sim.band(len(s)))
                        for x in s[often][: length - len(h)].tolist():
                            if (rep := first.get((x, band))) is None:
                                first[x, band] = (doc, len(s))
                            elif rep[0] != doc:
                                stars.add((rep[0], doc))
                    hs.append(h)
                    ds.append(np.full(len(h), doc, np.int64))
                    ss.append(np.full(len(h), len(s), np.int32))
                    ps.append(np.arange(len(h), dtype=np.int32))
                    bs.append(np.concatenate([np.zeros(1, np.uint64), h])[: len(h)])
                if hs:
                    yield packed(*map(np.concatenate, (hs, ds, ss, ps, bs)))
                if stars:
                    pairs = np.array(sorted(stars), np.int64)
                    buckets_of = pairs[:, 1] % buckets
                    used = np.unique(buckets_of)
                    blobs = [pairs[buckets_of == u].tobytes() for u in used]
                    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([-len(x) // 16 for x in blobs], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "n", "blob"])
        if first:
            h = np.array([x for x, _ in first], np.uint64)
            doc, size = (np.array(x) for x in zip(*first.values()))
            yield packed(h, doc.astype(np.int64), size.astype(np.int32), np.full(len(h), -1, np.int32), np.zeros(len(h), np.uint64))

    return run


def _candidates(sim: Similarity, group: int):
    """Pairs (kind 0) and edges that only connect (kind 1) from the entries of a bucket; rows come sorted by bucket."""

    def found(blobs: list[tuple[int, bytes]]) -> pa.RecordBatch | None:
        parts, stars = [[], [], [], [], []], []
        for k, blob in blobs:
            if k < 0:
                stars.append(np.frombuffer(blob, np.int64).reshape(-1, 2))
                continue
            lo = 0
            for i, kind in enumerate((np.uint64, np.int64, np.int32, np.int32, np.uint64)):
                size = k * np.dtype(kind).itemsize
                parts[i].append(np.frombuffer(blob[lo : lo + size], kind))
                lo += size
        pairs = [np.zeros((0, 2), np.int64)]
        if parts[0]:
            h, doc, size, place, before = map(np.concatenate, parts)
            order = np.lexsort((doc, size, h))
            h, doc, size, place, before = h[order], doc[order], size[order].astype(np.int64), place[order].astype(np.int64), before[order]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            ends = np.append(starts[1:], len(h))
            often = np.minimum.reduceat(place, starts) < 0
            m = ends - starts
            # by size, each entry of a large group with the next; one that stands for others reaches as far as its band's neighbour
            chained = np.repeat((m > 1) & ((m > group) | often), m)
            chained[ends - 1] = False
            at = np.flatnonzero(chained)
            band = sim.band(size)
            at = at[sim.sizes_fit(size[at], size[at + 1]) | (np.repeat(often, m)[at] & (band[at + 1] - band[at] <= 1))]
            stars.append(np.stack([doc[at], doc[at + 1]], axis=1))
            small = (m > 1) & (m <= group) & ~often
            for k in np.unique(m[small]).tolist():  # groups of one size at a time
                i, j = np.triu_indices(k, 1)
                whole = starts[small & (m == k)]
                run = max(1, MADE // len(i))
                for lo in range(0, len(whole), run):
                    at = whole[lo : lo + run]
                    a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                    most = np.minimum(size[a] - place[a], size[b] - place[b])  # if this is their first common number
                    ok = sim.sizes_fit(size[a], size[b]) & sim.enough(most, size[a], size[b]) & (doc[a] != doc[b])
                    ok &= (before[a] != before[b]) | (np.minimum(place[a], place[b]) == 0)  # else the number before has found them
                    pairs.append(np.stack([np.minimum(doc[a[ok]], doc[b[ok]]), np.maximum(doc[a[ok]], doc[b[ok]])], axis=1))
        p = np.unique(np.concatenate(pairs), axis=0)
        s = np.unique(np.concatenate(stars), axis=0) if stars else np.zeros((0, 2), np.int64)
        s = s[s[:, 0] != s[:, 1]]
        both = np.concatenate([p, s])
        kind = np.repeat([0, 1], [len(p), len(s)])
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams")
        bucket, blobs = None, []
        for b in batches:
            for w, k, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "n", "blob"))):
                if w != bucket and blobs:
                    yield found(blobs)
                    blobs = []
                bucket = w
                blobs.append((k, blob))
        if blobs:
            yield found(blobs)

    return run


def _within_bound(sim: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("sa", "na", "sb", "nb")))
            ok = [sim.enough(bound(sa, na, sb, nb), na, nb) for sa, na, sb, nb in rows]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _arrays(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams")
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("units"), pa.array([s.tobytes() for s in sets_of(b.column("text"), n)], pa.binary())], names=["doc", "units", "numbers"])

    return run


def _within_tile(sim: Similarity, exact: bool):
    """Edges of one tile: roles are 0 and 1 for its two blocks, or 2 where both are the same. All pairs are bounded by bit
    counts; with ``exact``, those within the bound are decided by their sorted arrays. What is connected already isn't compared again."""

    def run(table: pa.Table) -> pa.Table:
        doc, role = np.asarray(table.column("doc")), np.asarray(table.column("role"))
        if exact:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("numbers")]
            size, raw = np.array([len(s) for s in sets]), [np.frombuffer(signature(s), np.uint8) for s in sets]
        else:
            size, raw = np.asarray(table.column("n")), [np.frombuffer(x.as_py(), np.uint8) for x in table.column("sig")]
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        width = np.array([len(x) for x in raw])
        folded: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def at_width(w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Where rows of at least this width are, their signatures folded to it, and the bits of each."""
            if w not in folded:
                some = np.flatnonzero(width >= w)
                sigs = np.stack([fold(raw[k], w) for k in some.tolist()]).view(np.uint64)
                where = np.zeros(len(raw), np.int64)
                where[some] = np.arange(len(some))
                folded[w] = where, sigs, np.bitwise_count(sigs).sum(axis=1, dtype=np.int64)
            return folded[w]

        group = np.arange(len(doc))
        out = []
        for i in left.tolist():
            js = right[right > i] if role[i] == 2 else right
            js = js[(group[js] != group[i]) & (doc[js] != doc[i]) & sim.sizes_fit(size[i], size[js])]
            if not len(js):
                continue
            most = np.zeros(len(js), np.int64)
            common_width = np.minimum(width[js], width[i])
            for w in np.unique(common_width).tolist():
                where, sigs, bits = at_width(w)
                at = common_width == w
                a, b = where[i], where[js[at]]
                shared = np.bitwise_count(sigs[b] & sigs[a]).sum(axis=1, dtype=np.int64)
                most[at] = np.minimum(size[i] - (bits[a] - shared), size[js[at]] - (bits[b] - shared))
            ok = sim.enough(most, size[i], size[js])
            for j in js[ok][np.argsort(-most[ok], kind="stable")].tolist():
                if group[j] != group[i] and (not exact or sim.enough(common(sets[i], sets[j]), size[i], size[j])):
                    out.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
                    group[group == group[j]] = group[i]
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def _tiles(groups: DataFrame, heads: DataFrame, block: int, sim: Similarity, n_classes: int) -> DataFrame:
    """(doc, u: struct<unit, role>) of every tile that a document of ``groups`` (node, component) is in.

    A component is cut into size bands, and these into blocks of up to about ``block`` numbers and ``BLOCK_ROWS`` documents,
    dealt by hash; each pair of blocks of one band or of two side by side is a tile."""
    sized = groups.join(heads.select(F.col("doc").alias("node"), "n").hint("merge"), "node")
    banded = cut(sized.withColumn("band", F.floor(F.log("n") / sim.step + 1e-9).cast("int")))
    rows = F.count(F.lit(1))
    blocks = F.ceil(F.greatest(F.sum("n") / block, rows / BLOCK_ROWS)).cast("int")
    counts = cut(banded.groupBy("component", "band").agg(blocks.alias("blocks"), rows.alias("weight")))
    above = counts.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = counts.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    plan = cut(counts.join(above.hint("merge"), ["component", "band"], "left").join(below.hint("merge"), ["component", "band"], "left"))
    placed = join_counted(banded, plan, ["component", "band"], max(1, n_classes), "weight", "node")
    here = placed.withColumn("s", F.pmod(F.xxhash64("node"), F.col("blocks")))
    span = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda *parts: F.concat_ws(":", F.col("component"), *parts)
    tile = lambda lo_band, lo_s, hi_band, hi_s, role: F.struct(unit(lo_band, lo_s, hi_band, hi_s).alias("unit"), role.cast("int").alias("role"))
    band, s = F.col("band"), F.col("s")
    own = F.transform(span(F.col("blocks")), lambda o: tile(band, F.least(s, o), band, F.greatest(s, o), F.when(s == o, 2).when(s < o, 0).otherwise(1)))
    up = F.transform(span(F.col("above")), lambda o: tile(band, s, band + 1, o, F.lit(0)))
    down = F.transform(span(F.col("below")), lambda o: tile(band - 1, o, band, s, F.lit(1)))
    return here.select(F.col("node").alias("doc"), F.explode(F.concat(own, up, down)).alias("u"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_gram: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id): of each document its set's size and the least id that links reach.

    Words are lower-cased (A-Z). Sets link when their Jaccard similarity is at least ``percent`` / 100, exactly. A text with
    fewer words than a gram has one gram of all its words; without words, or null, it links with nothing. Rows that repeat an
    id take part with each of their texts and share one component; rows without an id get a component of null. An empty
    table gives no rows. Grams are compared by 64-bit hashes."""
    spark = docs.sparkSession
    sim = Similarity(percent)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    prof = cut(source.mapInArrow(_profile(words_in_gram), "doc long, n long, h long, print binary, sig binary"))
    each = prof.where("h is null").select("doc", "n", "print", "sig")
    known = each.where("print is not null and doc is not null")
    # 1. equal sets
    classes = cut(known.groupBy("print").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("rows")))
    totals = classes.agg(F.sum("rows"), F.count(F.lit(1))).first()
    n_rows, n_classes = totals[0] or 0, totals[1]
    member = cut(join_counted(known.select("doc", "print"), classes, ["print"], n_rows, "rows", "doc").select("doc", "rep").distinct())
    # a repeated id can stand for several sets; its row with the class's own print is taken
    heads = each.join(classes.select(F.col("rep").alias("doc"), "print").hint("merge"), ["doc", "print"], "left_semi").dropDuplicates(["doc", "print"])
    heads = cut(heads.select("doc", "n", "sig"))
    once = source.join(heads.select("doc").distinct().hint("merge"), "doc", "left_semi")
    # 2. numbers that many documents have
    marks = np.zeros(1 << MARK_BITS - 3, np.uint8)
    limit = 1 << MARK_BITS - 4
    often = prof.where("h is not null").groupBy("h").agg(F.sum("n").alias("n"))
    least = often.groupBy(F.least(F.floor(F.log2("n")), F.lit(62)).alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()
    kept, floor = 0, 62
    for level, k in sorted(((r["level"], r["k"]) for r in least), reverse=True):
        if kept + k > limit:
            break
        kept, floor = kept + k, level
    #: at most ``limit`` numbers reach the driver, as a bitmap of their slots in one row for each 4096 slots
    slots = often.where(F.col("n") >= F.lit(2.0**floor)).select("h")

    def slot_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = (mix(np.asarray(b.column("h")).view(np.uint64)) >> np.uint64(64 - MARK_BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(s))], names=["slot"])

    for b in slots.mapInArrow(slot_bits, "slot int").toArrow().column("slot").chunks:
        s = np.asarray(b)
        np.bitwise_or.at(marks, s >> 3, (1 << (s & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast(marks.tobytes())  # 2 MB whatever the input
    # 3. candidates
    buckets = 1 << max(3, math.ceil(math.log2(max(1, n_classes / 512))))
    group = min(MOST_GROUP, max(GROUP, n_classes // GROUP_PARTS))
    entries = once.mapInArrow(_entries(words_in_gram, sim, shared, buckets), "bucket long, n long, blob binary")
    dealt = entries.repartition("bucket").sortWithinPartitions("bucket")
    found = cut(dealt.mapInArrow(_candidates(sim, group), "kind int, a long, b long"))
    pairs = found.where("kind = 0").select("a", "b").distinct()
    left = heads.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = heads.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    bounded = cut(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "na", "sa", "b", "nb", "sb").mapInArrow(_within_bound(sim), "a long, b long"))
    # 4. tiles over what stars and bounded pairs connect: by signatures, then what these leave by arrays
    loose = connected_components(found.where("kind = 1").select("a", "b").unionByName(bounded))
    rough = _tiles(loose, heads, SIGNED_BLOCK, sim, n_classes).select("doc", "u.unit", "u.role").join(heads.hint("merge"), "doc")
    near = rough.groupBy("unit").applyInArrow(_within_tile(sim, False), "a long, b long")
    tight = connected_components(near)
    wanted = _tiles(tight, heads, BLOCK, sim, n_classes).groupBy("doc").agg(F.collect_list("u").alias("units"))
    arrays = once.join(wanted.hint("merge"), "doc").mapInArrow(_arrays(words_in_gram), "doc long, units array<struct<unit:string,role:int>>, numbers binary")
    units = arrays.select("doc", F.explode("units").alias("u"), "numbers").select("doc", "u.unit", "u.role", "numbers")
    links = cut(units.groupBy("unit").applyInArrow(_within_tile(sim, True), "a long, b long").distinct())
    # 5. groups
    reach = connected_components(links.unionByName(member.where("doc <> rep").groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")))
    merged = member.join(reach.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").groupBy("doc").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    size = each.select("doc", F.col("n").alias("n_shingles"))
    out = size.join(merged.hint("merge"), "doc", "left")
    return out.select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))
