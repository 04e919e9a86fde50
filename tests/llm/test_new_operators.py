"""Operators 11 to 13 and their registered queries against plain versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from tests.llm import brute
from veilmark.llm import conversation_repair, nearest_vectors, periodic_runs, queries
from veilmark.llm.embedding_dedup import Forest, unit
from veilmark.llm.hashing import mix

BLANKS = " \t\n\x0b\x0c\r"


def split(text):
    return [w for w in "".join(" " if c in BLANKS else c for c in text or "").split(" ") if w]


# 11. runs


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def repeating(r, letters=3):
    out = []
    for _ in range(r.randint(0, 5)):
        if r.random() < 0.5:
            out += [r.randint(0, letters) for _ in range(r.randint(0, 20))]
        else:
            unit_ = [r.randint(0, letters) for _ in range(r.randint(1, 14))]
            if r.random() < 0.5:
                unit_ = unit_ * r.randint(1, 4) + [r.randint(0, 3) for _ in range(r.randint(0, 3))]
            out += (unit_ * 20)[: r.randint(2, 9) * len(unit_) + r.randint(0, len(unit_))]
    return out


def test_runs_of_repeating_words():
    r, seen = random.Random(5), 0
    for _ in range(600):
        docs = [repeating(r, r.randint(1, 3)) for _ in range(r.randint(1, 4))]
        of_doc = np.cumsum([0, *map(len, docs)])
        h = mix(np.array([w for d in docs for w in d], np.uint64) + np.uint64(9))
        want = [(s + int(of_doc[i]), n, q) for i, d in enumerate(docs) for s, n, q in plain_runs(d)]
        assert list(zip(*(c.tolist() for c in periodic_runs.find_runs(h, of_doc)))) == sorted(want)
        seen += len(want)
    assert seen > 1000


def test_wavelet_tree():
    r = np.random.default_rng(2)
    values = r.integers(0, 300, 500)
    tree = periodic_runs.WaveletTree(values)
    for _ in range(200):
        lo, hi = sorted(r.integers(0, 501, 2).tolist())
        v, part = int(r.integers(0, 600)), np.sort(values[lo:hi])
        at = lambda x: np.array([x])
        assert tree.below(at(lo), at(hi), at(v))[0] == (part < v).sum()
        for k in range(0, len(part), 37):
            assert tree.smallest(at(lo), at(hi), at(k))[0] == part[k]


def test_runs_that_hashes_extend_too_far(monkeypatch):
    """Extensions by hash are compared word for word; where they go wrong, the words decide."""
    h = mix(np.array([1, 2] * 6 + [3, 4, 5], np.uint64))
    right = periodic_runs.Extensions.right
    monkeypatch.setattr(periodic_runs.Extensions, "right", lambda self, x, y: np.minimum(right(self, x, y) + 2, self.end[y - 1] - y))
    assert [c.tolist() for c in periodic_runs.find_runs(h, np.array([0, 15]))] == [[0], [12], [2]]


def damaged(doc_id, text):
    w = split(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def plain_periods(doc_id, text):
    w = damaged(doc_id, text)
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    digest = brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
    kept = brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, kept)


def test_periodic_query(spark, tmp_path):
    r = random.Random(3)
    texts = ["  ".join(f"é{x}" for x in repeating(r)) for _ in range(150)] + [None, "", " \n\t", "one", " a a a a a a ", "a b\tb b\x0bb b b\n"]
    texts += [" ".join(f"w{r.randrange(5000)}" for _ in range(9000)), "ab " * 3000]
    docs = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, "x y x y x y x y"), (None, None), (-4, texts[0])]
    spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, n_words int, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = [plain_periods(*d) for d in docs]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 100


def test_runs_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c", 5, "x")], "doc_id long, text string, n_words int, lang string")
    row = periodic_runs.periodic_runs(docs).first().asDict(recursive=True)
    assert row == {"doc_id": 1, "lang": "x", "n_words": 9, "runs": [{"start": 0, "length": 8, "period": 2}], "collapsed": "a b c"}
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


# 12. conversations


def plain_repair(rows):
    """(cost, audit, repaired) by trying all edits, on few rows: (role, text, must go, truncated)."""
    best = {(0, 0): (0, "", ())}  # (rows done, state) -> least
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    role_of = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    layers = [{} for _ in range(len(rows) + 1)]
    layers[0][0] = (0, "", ())
    del best
    for i in range(len(rows) + 1):
        layer = layers[i]
        for _ in range(4):  # put in
            for s, (c, a, out) in list(layer.items()):
                new = (c + 2, a + "I", (*out, (role_of[s], "")))
                if step[s] not in layer or new < layer[step[s]]:
                    layer[step[s]] = new
        if i == len(rows):
            break
        role, text, must, short = rows[i]
        for s, (c, a, out) in layer.items():
            options = [(s, (c + 3, a + "D", out))]
            if not must:
                options.append((step[s], (c + 2 + short, a + "R", (*out, (role_of[s], text)))))
                if role[:1] == role_of[s][0]:
                    options.append((step[s], (c + short, a + "K", (*out, (role, text)))))
                if role[:1] == "s" and s == 0:
                    options.append((1, (c + short, a + "K", (*out, (role, text)))))
            for to, new in options:
                if to not in layers[i + 1] or new < layers[i + 1][to]:
                    layers[i + 1][to] = new
    return min(layers[-1][s] for s in (0, 3) if s in layers[-1])


def plain_conversations(rows):
    """The contract of op12 over (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if c == 1 else "".join(x for x in text if x not in ".!?") if c == 2 else text
        held += [(turn, "user" if c == 4 else role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    return [plain_conversation(conv, held) for conv, held in convs.items()]


def plain_conversation(conv, held):
    held = sorted(held, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, classed, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in held:
        shown = text.rstrip(BLANKS)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        classed.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = [t for t, _, _ in held if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
    cost, audit, out = plain_repair(classed)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n.values(), illegal, cost, audit, digest)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(r, n, longest=9):
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            turn = r.choice([turn, turn, turn, turn + 3, None])
            text = r.choice(["a.", "b!", "c?", "no end", "", " \n", None, "a.", f"w{r.randrange(9)}. \t"])
            rows.append((conv, turn, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), text))
    return rows


def test_conversation_query(spark, tmp_path):
    r = random.Random(8)
    rows = conversations(r, 400) + [(None, 1, "user", "a."), (None, None, None, None), (5, 0, "user", "x."), (5, 0, "user", "x."), (5, 0, "user", "x."), (900, 1, "user", "long " * 30_000)]
    spark.createDataFrame([(*x, "c", True) for x in rows], "conv_id long, turn long, role string, text string, audit string, done boolean").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_conversations(rows), key=repr)


def test_long_conversations_are_joined_from_ranges(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "LONG", 40)
    r = random.Random(4)
    rows = [(conv, turn, r.choice(["user", "assistant", "system"]), r.choice(["a.", "ok", "", f"{turn}.", f"{turn}."])) for conv in (1, 2, 3) for turn in range(150 * conv)]
    rows += [(4, 7, "user", "same.")] * 130 + conversations(r, 30)[:60]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, conversation_repair.repair(frame).select(COLUMNS).collect()), key=repr)
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == sorted((plain_conversation(c, held) for c, held in convs.items()), key=repr)


def test_transitions_can_be_joined():
    r = random.Random(1)
    for _ in range(200):
        rows = [(r.choice("suax"), r.random() < 0.3, r.random() < 0.3) for _ in range(r.randint(0, 12))]
        k = r.randint(0, len(rows))
        whole, left, right = (conversation_repair.transitions(x) for x in (rows, rows[:k], rows[k:]))
        for s, t in itertools.product(range(4), range(4)):
            ways = [(left[s][m][0] + right[m][t][0], left[s][m][1] + right[m][t][1]) for m in range(4) if left[s][m] and right[m][t]]
            assert whole[s][t] == min(ways, default=None)


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 7, 1])
def test_audits_compare_as_strings(monkeypatch, prime):
    """With few hashes nearly all collide, and letters decide."""
    monkeypatch.setattr(conversation_repair, "_PRIME", prime)
    r, audits, nodes = random.Random(6), conversation_repair.Audits(), [0]
    for _ in range(300):
        nodes.append(audits.add(r.choice(nodes[-20:]), r.choice("DIKR")))
    for _ in range(3000):
        a, b = r.choice(nodes), r.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(frame).count() == 0


# 13. nearest vectors


def plain_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 2 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i is not None and i % 50 == 0:
            near = sorted((-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), j is None, j or 0) for n, (j, w) in enumerate(good) if n != at)[:k]
            out += [(i, n + 1, None if none else j, round(-s, 12)) for n, (s, none, j) in enumerate(near)]
    return sorted(out, key=repr)


def test_nearest_query(spark, tmp_path):
    rows = [(i, [float(i % 7 - 3), float(i % 11 - 5)]) for i in range(230)]
    rows += [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (None, [1.0, 2.0]), (1000, None), (1050, [0.0, 0.0]), (1100, [None, 1.0]), (1150, [float("nan"), 1.0]), (1200, [1.0]), (1250, [float("inf"), 1.0])]
    rows += [(2000 + i, [2.0, 4.0]) for i in range(40)]
    spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, rank int, node int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(q, n, v, round(s, 12)) for q, n, v, s in queries.op13_nearest_vectors(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()]
    want = plain_nearest(rows)
    assert sorted((q, n, s) for q, n, _, s in got) == sorted((q, n, s) for q, n, _, s in want)
    # equal angles of unequal lengths may differ in the last bit, so ids are compared where no other row is as near
    alone = lambda some: {(q, v) for q, _, v, s in some if sum(x[0] == q and x[3] == s for x in want) == 1 and s != min(x[3] for x in want if x[0] == q)}
    assert alone(got) == alone(want)


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_recall_of_deep_forests(spark, clustered):
    """Against brute force on random vectors, which no tree can part well, and on clustered ones."""
    r = np.random.default_rng(7)
    x = r.standard_normal((4000, 24))
    if clustered:
        x = r.standard_normal((40, 24))[r.integers(0, 40, 4000)] + 0.15 * x
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = nearest_vectors.nearest(frame, F.col("vec_id") % 20 == 0, k=5, leaf=64).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    found = {}
    for q in got:
        found.setdefault(q["query_id"], []).append(q["vec_id"])
        assert abs(q["score"] - u[q["query_id"]] @ u[q["vec_id"]]) < 1e-12
    for q in range(0, 4000, 20):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & set(found[q]))
        assert len(found[q]) == 5
    assert hit >= 0.95 * 1000


def test_queue_takes_the_nearest_leaves_first():
    r = np.random.default_rng(3)
    x, _ = unit(__import__("pyarrow").array(r.standard_normal((500, 6)).tolist()))
    forest = Forest(x, 3, 3, 0.0, 1)
    far = nearest_vectors.penalties(forest, x[:20])
    for i, leaves in enumerate(nearest_vectors.visits(forest, x[:20], 24)):
        cost = [far[i, leaf >> 55, (leaf & (1 << 55) - 1) - 8] for leaf in leaves]
        assert len(set(leaves)) == 24 and np.allclose(cost, np.sort(far[i].ravel()))


def test_copies_are_answered_together(spark):
    """A vector that a third of all rows have: the least ids answer, and each of its queries is answered."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else r.standard_normal(3).tolist()) for i in range(3000)]
    got = nearest_vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, leaf=64)
    same = {(q["query_id"], q["rank"]): q["vec_id"] for q in got.collect() if q["query_id"] % 3 == 0}
    for q in range(0, 3000, 150):
        assert [same[q, k + 1] for k in range(5)] == [i for i in range(0, 21, 3) if i != q][:5]


def test_no_vectors(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest_vectors.nearest(frame, F.col("vec_id") % 50 == 0).count() == 0
    some = spark.createDataFrame([(1, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest_vectors.nearest(some, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1, 1.0)]
