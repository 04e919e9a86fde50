"""Entity scores, token windows, reliability records and annotators against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veilmark.operators import hooks, span_scores, spans

KINDS = ["A", "B", "C"]


def plain_spans(labels):
    """(spans, orphans) of valid tags."""
    out, start, kind, orphans = [], None, None, 0
    for i, tag in enumerate([*labels, "O"]):
        now = tag[2:] if tag != "O" else None
        goes_on = tag.startswith("I-") and now == kind
        orphans += tag.startswith("I-") and not goes_on
        if kind is not None and not goes_on:
            out.append((start, i - 1, kind))
        if not goes_on:
            start, kind = i, now
    return out, orphans


def some_tags(r, n, valid):
    tags = []
    for _ in range(n):
        t = r.choice(["O", "O", "B-A", "B-B", "I-A", "I-B", "I-C"])
        if valid and t.startswith("I-") and not (tags and tags[-1] != "O" and tags[-1][2:] == t[2:]):
            t = "B" + t[1:]
        tags.append(t)
    return tags


def labelled(r, n=120):
    docs = [(i, some_tags(r, k := r.randint(0, 12), True), some_tags(r, k, False)) for i in range(n)]
    return docs + [(n, [], []), (n + 1, ["O", "O"], ["I-A", "I-A"]), (n + 2, ["B-A"], ["O"])]


def frame(spark, docs):
    return spark.createDataFrame(docs, "id long, gold array<string>, predicted array<string>").repartition(3)


def test_the_automaton_reads_bio_labels(spark):
    docs = labelled(random.Random(1))
    got = frame(spark, docs).select("id", span_scores.decode_bio(F.col("predicted")).alias("d")).collect()
    plain = {i: plain_spans(p) for i, _, p in docs}
    for r in got:
        assert ([tuple(s) for s in r["d"]["spans"]], r["d"]["orphans"], r["d"]["malformed"]) == (*plain[r["id"]], 0)


def test_malformed_labels_are_counted_and_refused(spark):
    df = frame(spark, [(1, ["O", "B-A"], ["X", "B-"])])
    d = df.select(span_scores.decode_bio(F.col("predicted")).alias("d")).first()["d"]
    assert d["spans"] == [] and d["malformed"] == 2
    for gold, predicted in ((["O"], ["X"]), (["I-A"], ["O"]), (["O"], ["O", "O"]), (["B-A", "I-B"], ["O", "O"])):
        with pytest.raises(Exception, match="malformed|cover|beginning"):
            span_scores.decoded(frame(spark, [(1, gold, predicted)]), "gold", "predicted").collect()


def test_class_and_document_scores(spark):
    docs = labelled(random.Random(2))
    d = span_scores.decoded(frame(spark, docs), "gold", "predicted")
    categories = [*KINDS, "never"]
    got = {(r["level"], r["type"]): r for r in span_scores.class_scores(d, categories).collect()}
    g, p = ([(i, *s) for i, *x in docs for s in plain_spans(x[k])[0]] for k in (0, 1))
    for k in categories:
        gk, pk = ({s for s in side if s[3] == k} for side in (g, p))
        r = got["class", k]
        assert (r["support"], r["predicted"], r["true_positive"]) == (len(gk), len(pk), len(gk & pk))
        assert r["recall"] == (len(gk & pk) / len(gk) if gk else None) and r["f1"] == (2 * len(gk & pk) / (len(gk) + len(pk)) if gk or pk else None)
        assert r["precision"] == (len(gk & pk) / len(pk) if pk else 0.0)
    assert got["micro", None]["true_positive"] == len(set(g) & set(p)) and got["micro", None]["support"] == len(g)
    supported = [got["class", k]["f1"] for k in categories if got["class", k]["support"]]
    assert math.isclose(got["macro", None]["f1"], sum(supported) / len(supported))
    one = span_scores.document_scores(d).first()
    has = [(bool(plain_spans(a)[0]), bool(plain_spans(b)[0]), plain_spans(b)[1] > 0) for _, a, b in docs]
    assert tuple(one)[:6] == (len(docs), sum(a for a, *_ in has), sum(a and not b for a, b, _ in has), sum(not a for a, *_ in has), sum(not a and b for a, b, _ in has), sum(c for *_, c in has))
    assert span_scores.document_scores(d.where("false")).first()["false_positive_rate"] is None


def test_strict_scores_on_all_levels(spark):
    r = random.Random(3)
    mention = lambda: (r.randrange(40), "", r.randrange(4), 5 + r.randrange(2), r.choice(KINDS))
    side = lambda n: [(i, f"s{i % 3}", a, b, k) for i, _, a, b, k in (mention() for _ in range(n))]
    gold, found = side(90), side(90)
    gold += gold[:5]
    names = "record long, source string, start long, end long, type string"
    records = spark.createDataFrame([(i,) for i in range(60)], "record long")
    train = spark.createDataFrame([("A", 50), ("B", 6), ("B", 4)], "type string, n long")
    got = {(x["level"], x["key"]): x for x in span_scores.strict_scores(spark.createDataFrame(gold, names), spark.createDataFrame(found, names), records, train).collect()}
    g, p = set(gold), set(found)
    n = lambda k, c: tuple(sum(1 for x in s if c(x)) for s in (g & p, p - g, g - p))
    want = {("micro", ""): n("", lambda x: True)} | {("type", k): n(k, lambda x: x[4] == k) for k in KINDS} | {("source", f"s{s}"): n(s, lambda x: x[1] == f"s{s}") for s in range(3)}
    for key, counts in want.items():
        assert (got[key]["tp"], got[key]["fp"], got[key]["fn"]) == counts, key
        tp, fp, fn = counts
        assert math.isclose(got[key]["f1"], 2 * tp / (2 * tp + fp + fn))
    rare = [sum(x) for x in zip(want["type", "B"], want["type", "C"])]
    assert [got["rare", ""][c] for c in ("tp", "fp", "fn")] == rare and got["rare", ""]["precision"] is None
    places = [{x[:4] for x in s} for s in (g, p)]
    assert got["untyped", ""]["recall"] == len(places[0] & places[1]) / len(places[0])
    clean = set(range(60)) - {x[0] for x in g}
    assert got["clean", ""]["recall"] == len(clean - {x[0] for x in p}) / len(clean)
    assert math.isclose(got["macro", ""]["f1"], sum(got["type", k]["f1"] for k in KINDS) / 3)
    nothing = spark.createDataFrame([], names)
    empty = {x["level"]: x for x in span_scores.strict_scores(nothing, nothing, records.limit(0), train).collect()}
    assert empty["clean"]["recall"] is None and empty["rare"]["recall"] is None and empty["macro"]["f1"] == 0.0


def plain_windows(pieces, budget, unknown):
    kept = [[unknown] if not p else p if len(p) <= budget else p[: (budget + 1) // 2] + (p[-(budget // 2) :] if budget // 2 else []) for p in pieces]
    out, at = [], 0
    while at < len(kept):
        end, size = at, 0
        while end < len(kept) and size + len(kept[end]) <= budget:
            size += len(kept[end])
            end += 1
        out.append((at, end - 1, [x for p in kept[at:end] for x in p], [x for i in range(at, end) for x in [i] + [-1] * (len(kept[i]) - 1)]))
        at = end
    return out


@pytest.mark.parametrize("budget", [1, 2, 7, 16])
def test_windows_hold_every_token_once(spark, budget):
    r = random.Random(budget)
    docs = [(i, [list(range(k := r.randrange(100), k + r.choice([0, 1, 1, 2, 5, 20]))) for _ in range(r.randrange(15))]) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, pieces array<array<int>>")
    w = spans.token_windows(df, "pieces", budget, unknown=-7)
    for x in w.collect():
        pieces = docs[x["id"]][1]
        assert [(a["first"], a["last"], a["ids"], a["words"]) for a in x["windows"]] == plain_windows(pieces, budget, -7)
        assert [(t["subwords"], t["head"] + t["tail"] + t["discarded"]) for t in x["ledger"]] == [(len(p), len(p)) for p in pieces]
    c = spans.window_coverage(w).first()
    sizes = [len(p) for _, d in docs for p in d]
    assert (c["documents"], c["tokens"], c["oversized"], c["unknown"]) == (60, len(sizes), sum(s > budget for s in sizes), sizes.count(0))
    assert c["discarded_subwords"] == sum(max(0, s - budget) for s in sizes) and c["retained_subwords"] == sum(min(max(s, 1), budget) for s in sizes)


def test_reliability_records(spark):
    rows = [(1, 0, [0.1, 0.8, 0.1], True), (1, 1, [0.2, 0.2, 0.6], True), (1, 2, [0.9, 0.05, 0.05], True), (1, 3, [0.0, 0.0, 1.0], False), (2, 0, [0.7, 0.2, 0.1], True), (2, 1, [0.5, 0.5, 0.0], True), (3, 0, [0.0, 1.0, 0.0], False)]
    df = spark.createDataFrame(rows, "record long, idx int, probs array<double>, valid boolean")
    got = {r["record"]: r for r in span_scores.reliability_records(df, ["O", "B-T", "I-T"]).collect()}
    entropy = lambda p: -sum(x * math.log(x) for x in p if x) / math.log(3)
    assert [(e["first"], e["last"], e["type"], e["confidence"]) for e in got[1]["entities"]] == [(0, 1, "T", 0.6)]
    assert math.isclose(got[1]["entities"][0]["uncertainty"], max(entropy(rows[0][2]), entropy(rows[1][2])), abs_tol=1e-9)
    assert got[1]["confidence"] == 0.6 and math.isclose(got[1]["uncertainty"], entropy(rows[1][2]), abs_tol=1e-9)
    assert got[2]["entities"] == [] and got[2]["confidence"] == 0.5 and math.isclose(got[2]["uncertainty"], max(entropy(rows[4][2]), entropy(rows[5][2])), abs_tol=1e-9)
    assert got[3]["entities"] == [] and got[3]["confidence"] == 0.0 and got[3]["uncertainty"] == 1.0


class Model:
    """Loaded once a task; fails on texts with a digit."""

    loads = 0

    def __init__(self):
        type(self).loads += 1
        self.own = type(self).loads

    def __call__(self, texts):
        if any(c.isdigit() for t in texts for c in t):
            raise ValueError("digits")
        return [([(str(self.own), "LOADS")], [(w, "dep", "root", w == ".") for w in t.split()]) for t in texts]


def test_annotators_are_loaded_once_and_fail_by_row(spark):
    texts = ["a . b", "x1 y", None, ". .", "w " * 80] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    got = hooks.annotate_texts(df, Model, text_col="t", batch=7, dependencies=50).orderBy("id").collect()
    for r, t in zip(got, texts):
        a = r["annotation"]
        if t == "x1 y":
            assert (a["entities"], a["dependencies"], a["error"]) == ([], [], "ValueError: digits")
        else:
            assert a["error"] is None and [d["token"] for d in a["dependencies"]] == [w for w in (t or "").split() if w != "."][:50]
    assert len({r["annotation"]["entities"][0]["text"] for r in got if r["annotation"]["entities"]}) == 1
