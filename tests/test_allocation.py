"""Splits and orders by tags, ranks without hot windows and user code, against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilmark.operators import allocation, corpus, evidence, groups, hooks, labeling, metrics
from veilmark.scratch import checkpoint_dir

RATIOS = {"train": 0.6, "validation": 0.2, "calibration": 0.1, "test": 0.1}


def tagged(n=400, seed=4):
    r = random.Random(seed)
    kinds = ["a"] * 30 + ["b"] * 12 + ["c"] * 5 + ["d", "e"]
    return [(i, f"g{r.randrange(n // 2)}", sorted(set(r.sample(kinds, r.randrange(0, 4))))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, tags array<string>")


def one_by_one(signatures, ratios):
    """The plan of splits, group by group."""
    order = [s for s in ("train", "test", "validation", "calibration") if s in ratios]
    counts = Counter()
    for tags, n, _ in signatures:
        counts.update({t: n for t in tags})
    targets = allocation.tag_targets(dict(counts), ratios)
    total = sum(d for *_, d in signatures)
    room = {s: total * r for s, r in ratios.items()}
    have = {t: Counter() for t in counts}
    left, out = {t: (n, d) for t, n, d in signatures}, defaultdict(Counter)
    while left:
        now = Counter()
        for tags, (n, _) in left.items():
            now.update({t: n for t in tags})
        rare = min(now, key=lambda t: (now[t], t))
        for tags in sorted(t for t in left if rare in t):
            n, docs = left.pop(tags)
            by = sorted(ratios, key=lambda s: (-room[s], order.index(s)))
            want = {s: targets[rare][s] - have[rare][s] for s in ratios}
            for _ in range(n):
                s = max(by, key=lambda x: want[x])
                want[s] -= 1
                out[tags][s] += 1
            for s, k in out[tags].items():
                room[s] -= docs * k / n
                for t in tags:
                    have[t][s] += k
    return out


def test_rarest_first(spark):
    rows = tagged()
    got = allocation.rarest_first_split(frame(spark, rows), "g", "tags", RATIOS, "s").collect()
    assert len(got) == len(rows)
    split = {r["g"]: r["split"] for r in got}
    assert all(split[r["g"]] == r["split"] for r in got)  # groups stay whole
    features = defaultdict(set)
    for _, g, tags in rows:
        features[g] |= set(tags) | {"__positive__" if tags else "__negative__"}
    signatures = Counter(tuple(sorted(f)) for f in features.values())
    docs = Counter()
    for _, g, _ in rows:
        docs[tuple(sorted(features[g]))] += 1
    want = one_by_one(sorted((t, n, docs[t]) for t, n in signatures.items()), RATIOS)
    found = defaultdict(Counter)
    for g, s in split.items():
        found[tuple(sorted(features[g]))][s] += 1
    assert {t: +c for t, c in found.items()} == {t: +c for t, c in want.items()}
    for tag in ("d", "e"):  # rare tags reach train and test
        assert {s for g, s in split.items() if tag in features[g]} >= {"train", "test"} or sum(tag in f for f in features.values()) < 2


def test_targets_lend_places():
    t = allocation.tag_targets({"x": 3, "y": 100}, {"train": 0.9, "validation": 0.05, "test": 0.05})
    assert t["x"] == {"train": 1, "validation": 1, "test": 1} and t["y"] == {"train": 90, "validation": 5, "test": 5}


def test_bad_ratios(spark):
    with pytest.raises(ValueError):
        allocation.rarest_first_split(frame(spark, tagged(20)), "g", "tags", {"train": 0.5}, "s")


def test_nested_order(spark):
    rows = tagged() + [(1000 + i, f"r{i}", ["rare"]) for i in range(3)]
    got = sorted(allocation.nested_order(frame(spark, rows), "g", "tags", "s", rare=3).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len({g for _, g, _ in rows}) + 1))
    features = defaultdict(set)
    for _, g, tags in rows:
        features[g] |= set(tags)
    anchors = [r["g"] for r in got if r["anchor"]]
    assert [r["anchor"] for r in got] == [True] * len(anchors) + [False] * (len(got) - len(anchors))
    support = Counter(t for _, _, tags in rows for t in tags)
    assert {g for g, f in features.items() if any(support[t] <= 3 for t in f)} <= set(anchors)
    assert set().union(*(features[g] for g in anchors)) == set(support)
    for part in (0.3, 0.5, 0.8):  # prefixes are like the whole
        some = [r["g"] for r in got if not r["anchor"]][: int(part * (len(got) - len(anchors)))]
        for tag in ("a", "b"):
            share = sum(tag in features[r["g"]] for r in got) / len(got)
            assert abs(sum(tag in features[g] for g in some) / len(some) - share) < 0.1


def test_places_within_groups(spark):
    rows = [(i, [None, "x", "y"][i % 3] if i % 2 else "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string")
    got = {r["id"]: r["place"] for r in corpus.rank_within(df, ["k"], ["id"]).collect()}
    seen = Counter()
    for i, k in rows:
        seen[k] += 1
        assert got[i] == seen[k]


def test_splits_by_stratum(spark):
    rows = [(i, [None, "x", "y"][i % 3] if i % 2 else "x") for i in range(301)]
    df = spark.createDataFrame(rows, "id long, k string")
    digest = lambda i: hashlib.sha256(f"s|{i}".encode()).hexdigest()
    for by in ("k", None):
        got = {r["id"]: r["split"] for r in corpus.stratified_split(df, by, "id", "s").collect()}
        strata = defaultdict(list)
        for i, k in rows:
            strata[k if by else 0].append(i)
        for ids in strata.values():
            ids.sort(key=digest)
            t, v = math.floor(len(ids) * 0.7), math.floor(len(ids) * 0.15)
            assert [got[i] for i in ids] == ["train"] * t + ["validation"] * v + ["test"] * (len(ids) - t - v)
    least = min(Counter(k for _, k in rows).values())
    assert Counter(r["k"] for r in corpus.balanced(df, "k", "s", "id").collect()) == {k: least for k in (None, "x", "y")}
    assert corpus.stratified_split(df.limit(0), "k", "id", "s").isEmpty() and corpus.balanced(df.limit(0), "k", "s", "id").isEmpty()


def test_one_row_of_each_key_is_first(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, None), (3, None), (4, "b")]
    df = spark.createDataFrame(rows, "id long, t string")
    flagged = corpus.dedup_flag(df, F.lower(F.coalesce("t", F.lit(""))), [F.col("id")]).collect()
    assert Counter((r["t"], r["id"], r["is_duplicate"]) for r in flagged) == {("a", 1, False): 1, ("a", 1, True): 1, ("a", 2, True): 1, (None, 3, False): 1, (None, 3, True): 1, ("b", 4, False): 1}
    assert sorted((r["id"], r["retained_id"]) for r in groups.discard_equal_texts(df, F.col("t"), "id").collect()) == [(2, 1)]


def test_group_ids_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(i, f"k{i // 50}") for i in range(200)], "id long, k string")
    a = {r["id"]: r["group_id"] for r in groups.key_components(df, "id", [F.col("k")]).collect()}
    b = {r["id"]: r["group_id"] for r in groups.key_components(df.orderBy(F.desc("id")), "id", [F.col("k")]).collect()}
    assert a == b and len(set(a.values())) == 4


def test_risk_coverage(spark):
    rows = [(i, int(i % 7 == 0), (i * 37 % 100) / 100) for i in range(250)]
    df = spark.createDataFrame(rows, "id long, e int, u double")
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    risk = [sum(e for _, e, _ in order[: k + 1]) / (k + 1) for k in range(len(order))]
    assert abs(metrics.aurc(df, "e", "u", ["id"]).first()[0] - sum(risk) / len(risk)) < 1e-12
    curve = {r["point"]: (r["coverage"], r["risk"]) for r in metrics.risk_coverage_curve(df, "e", "u", ["id"]).collect()}
    assert all(abs(curve[i][1] - risk[-(-250 * i // 100) - 1]) < 1e-12 for i in range(1, 101))


def test_masked_agreement_is_null_without_observed_rows(spark):
    df = spark.createDataFrame([([0.9, 0.1], 0), ([0.2, 0.8], 0)], "p array<double>, y int")
    assert tuple(metrics.masked_agreement(df, "p", "y", F.lit(False)).first()) == (0, None, None)
    got = metrics.masked_agreement(df, "p", "y", F.lit(True)).first()
    assert got["agreement"] == 0.5 and abs(got["loss"] + (math.log(0.9) + math.log(0.2)) / 2) < 1e-12


def test_inconsistent_records(spark):
    schema = "id long, v array<int>, p array<double>"
    again = spark.createDataFrame([(1, [1], [0.5, 0.5]), (2, [1], [0.5, 0.5]), (3, [1], [0.5, 0.5]), (4, [1], [0.1, 0.9])], schema)
    stored = spark.createDataFrame([(1, [1], [0.5, 0.5 + 1e-9]), (2, [0], [0.5, 0.5]), (3, [1], [0.6, 0.4]), (5, [1], [0.1, 0.9])], schema)
    got = {r["id"]: r["reason"] for r in labeling.inconsistent(stored, again, "id", "v", "p").collect()}
    assert got == {2: "votes", 3: "posterior", 4: "not stored", 5: "not computed"}


def test_contradictions(spark):
    rows = [
        ("medical", "x", "medical_information_request", "low", 0.0),
        ("general_qa", "x", "medical_information_request", "low", 0.0),
        ("multi_hop_qa", "x", "medical_information_request", "medium", 1.0),
        ("general_qa", "the tax on trade", "financial_information_request", "high", 0.99),
        ("general_qa", "x", "financial_information_request", "high", 0.991),
        ("general_qa", "x", "identity_related_request", "low", 0.0),
        ("financial", "x", "general_information", "high", 1.0),
    ]
    got = {(r["domain"], r["rule"]): (r["n"], r["rate"]) for r in labeling.contradictions(spark.createDataFrame(rows, "domain string, text string, intent string, sensitivity string, organization double")).collect()}
    assert got == {
        ("medical", "medical_but_harmless"): (1, 1.0),
        ("general_qa", "medical_intent_elsewhere"): (1, 0.25),
        ("multi_hop_qa", "medical_intent_elsewhere"): (1, 1.0),
        ("multi_hop_qa", "medical_intent_in_hops"): (1, 1.0),
        ("multi_hop_qa", "organization_in_questions"): (1, 1.0),
        ("general_qa", "financial_intent_elsewhere"): (1, 0.25),
        ("general_qa", "organization_in_questions"): (1, 0.25),
        ("general_qa", "identity_in_general_questions"): (1, 0.25),
        ("financial", "sensitive_but_general"): (1, 1.0),
    }


def test_observer_changes_nothing(spark):
    def fails(stage, metrics):
        raise RuntimeError(stage)

    told = []
    for callback in (fails, lambda s, m: told.append((s, m["rows"], m["most"]))):
        watcher = hooks.StageObserver(callback)
        df = watcher.watch(spark.range(10), "all", most=F.max("id"))
        small = watcher.watch(df.where("id < 3"), "small", most=F.max("id"))
        assert sorted(r["id"] for r in small.collect()) == [0, 1, 2]
        assert watcher.report() == {"all": {"rows": 10, "most": 9}, "small": {"rows": 3, "most": 2}}
        assert set(watcher.failures) == ({"all", "small"} if callback is fails else set())
    assert told == [("all", 10, 9), ("small", 3, 2)]
    with pytest.raises(ValueError):
        watcher.watch(df, "all")


def test_encoder_and_evaluator(spark):
    def load():
        def encode(texts):
            assert len(texts) <= 2
            return [[len(t), 1.0] for t in texts]

        return encode

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id long, t string")
    assert {r["id"]: r["v"] for r in hooks.encode_texts(df, load, "v", "t", batch=2).collect()} == {1: [2, 1], 2: [0, 1], 3: [3, 1]}
    policies = spark.createDataFrame([("x", 2.0), ("y", 3.0)], "policy_id string, k double")

    def judge(k: pd.Series, i: pd.Series) -> pd.Series:
        return k * i

    got = hooks.evaluate_policies(df, policies, judge, ["k", "id"], "double").collect()
    assert {(r["id"], r["policy_id"]): r["observation"] for r in got} == {(i, p): i * k for i in (1, 2, 3) for p, k in (("x", 2), ("y", 3))}
    with pytest.raises(ValueError):
        hooks.evaluate_policies(df, policies, judge, ["k", "id"], "double", most=1)


def test_extractors(spark):
    known = hooks.Extractors()
    known.register("a")(lambda t: t.select(F.col("q").alias("query_text"), F.lit("").alias("context_text"), F.lit("d").alias("domain")))
    rows = known.extract({"a": spark.createDataFrame([("x",)], "q string")}).collect()
    assert [tuple(r) for r in rows] == [("x", "", "d", "a")]
    with pytest.raises(KeyError):
        known.extract({"b": spark.range(1)})
    with pytest.raises(ValueError):
        known.register("a")(None)


def test_trace(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "C")], "id long, t string")
    got = hooks.stage_trace(df, "id", "t", {"lower": lambda d: d.withColumn("t", F.lower("t")), "long": lambda d: d.where(F.length("t") > 2)}).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "lower", "A b", "a b"), (1, 1, "long", "a b", "a b"), (2, 0, "lower", "C", "c"), (2, 1, "long", "c", None)]
    with pytest.raises(ValueError):
        hooks.stage_trace(df, "id", "t", {}, most=1)


def test_nfkc_of_compatibility_characters(spark):
    from veilmark.functions.text import normalised

    df = spark.createDataFrame([("ﬁne",), ("Ａ１",), ("①²",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(normalised("t")).collect()] == ["fine", "A1", "12", "plain", ""]


def test_baseline_spans_have_offsets_of_their_text(spark):
    text = "Mail é@x.org? no: ann@mail.example or +1 415-555-0100, then (212) 555 0199."
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = df.select(evidence.baseline_spans(evidence.offset_matches("t"), {"email": "EMAIL", "phone": "PHONE_NUMBER"}).alias("s")).collect()
    assert [(text[s["start"] : s["end"]], s["type"]) for s in got[0]["s"]] == [("é@x.org", "EMAIL"), ("ann@mail.example", "EMAIL"), ("+1 415-555-0100", "PHONE_NUMBER"), ("(212) 555 0199", "PHONE_NUMBER")] and not got[1]["s"]


def test_checkpoint_folder_of_a_local_session(spark):
    assert checkpoint_dir(spark)
