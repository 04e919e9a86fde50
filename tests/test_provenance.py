"""Manifests, pinned files, damaged sources, nested adapters, scenarios, leakage, reconciliation, sensitivity of risk scores."""

import hashlib
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from veilmark.operators import allocation, groups, risk, scenarios
from veilmark.operators.skew import first_of_key
from veilmark.sources import manifest, readers


def three_stages(spark, tmp_path):
    at, man = lambda s: str(tmp_path / s), str(tmp_path / "manifest")
    manifest.write_stage(spark.range(20), at("a"), man, "a", {"k": 1})
    manifest.write_stage(spark.read.parquet(at("a")).where("id > 3"), at("b"), man, "b", {"k": 2}, "a")
    manifest.write_stage(spark.read.parquet(at("b")).where("id > 5"), at("c"), man, "c", {"k": 3}, "b")
    return at, man


def test_a_chain_is_verified_to_its_root(spark, tmp_path):
    at, man = three_stages(spark, tmp_path)
    assert manifest.verify_stage(spark, man, "c", {"k": 3}, {"a": {"k": 1}, "b": {"k": 2}}).count() == 14
    for config, configs, why in (({"k": 4}, None, "configuration"), ({"k": 3}, {"a": {"k": 9}}, "stage a was made with another configuration")):
        with pytest.raises(ValueError, match=why):
            manifest.verify_stage(spark, man, "c", config, configs)
    with pytest.raises(ValueError, match="no stage"):
        manifest.verify_stage(spark, man, "d", {})
    with pytest.raises(ValueError, match="no stage"):
        manifest.write_stage(spark.range(1), at("d"), man, "d", {}, "nowhere")
    spark.range(19).write.mode("overwrite").parquet(at("a"))
    with pytest.raises(ValueError, match="stage a has changed"):
        manifest.verify_stage(spark, man, "c", {"k": 3})


def test_the_latest_row_of_a_stage_counts(spark, tmp_path):
    at, man = three_stages(spark, tmp_path)
    for i in range(4):
        manifest.write_stage(spark.range(5 + i), at("b"), man, "b", {"k": i}, "a")
        assert manifest.verify_stage(spark, man, "b", {"k": i}).count() == 5 + i
        with pytest.raises(ValueError, match="written again"):
            manifest.verify_stage(spark, man, "c", {"k": 3})
    assert [r["seq"] for r in manifest.chain(spark, man)] == list(range(7))


def test_altered_rows_of_a_manifest_are_refused(spark, tmp_path):
    at, man = three_stages(spark, tmp_path)
    rows = manifest.chain(spark, man)
    spark.range(3).write.mode("overwrite").parquet(at("b"))
    rows[1]["fingerprint"] = manifest.fingerprint(spark.range(3))
    spark.createDataFrame(rows, manifest._ROW).write.parquet(man + "2")
    with pytest.raises(ValueError, match="altered"):
        manifest.verify_stage(spark, man + "2", "c", {"k": 3})
    rows[1]["link"] = manifest._link(rows[1])  # a new link breaks the child's bond
    spark.createDataFrame(rows, manifest._ROW).write.parquet(man + "3")
    with pytest.raises(ValueError, match="written again"):
        manifest.verify_stage(spark, man + "3", "c", {"k": 3})


def test_files_are_digested_in_chunks(spark, tmp_path, monkeypatch):
    sizes = {"empty.bin": 0, "one.bin": 1, "edge.bin": 4096, "more.bin": 10_001}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(os.urandom(size))
    want = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in sizes}
    got = {os.path.basename(r["path"]): (r["size"], r["sha256"]) for r in readers.file_digests(spark, str(tmp_path), chunk=4096).collect()}
    assert got == {n: (sizes[n], want[n]) for n in sizes}
    status = {r["name"]: r["status"] for r in readers.file_checks(spark, str(tmp_path), want | {"one.bin": "0", "gone.bin": "1"}).collect()}
    assert status == {"empty.bin": "ok", "one.bin": "changed", "edge.bin": "ok", "more.bin": "ok", "gone.bin": "missing"}


def test_digests_hold_a_chunk_of_a_file_at_most(tmp_path):
    """A file of a gigabyte (sparse) through the task's own function: memory stays near a chunk."""
    import resource

    import pyarrow as pa

    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.truncate(1 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = list(readers._streamed(1 << 20)([pa.RecordBatch.from_pydict({"path": [big.as_uri()]})]))
    assert out[0].column("size").to_pylist() == [1 << 30]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kilobytes


def test_damage_anywhere_passes_a_source_over(spark, tmp_path):
    lines = [json.dumps({"a": i}) for i in range(200_000)]
    lines[150_000] = '{"a": 1'
    (tmp_path / "bad.jsonl").write_text("\n".join(lines))
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "good.jsonl").write_text('{"a": 7}\n')
    sources = [("real_local", str(tmp_path / "bad.jsonl")), ("real_cached", str(tmp_path / "empty.jsonl")), ("real", str(tmp_path / "good.jsonl"))]
    assert [tuple(r) for r in readers.first_source(spark, sources, "a int", whole=True).collect()] == [(7, "real")]
    with pytest.raises(FileNotFoundError):
        readers.first_source(spark, sources[:2], "a int", whole=True)
    assert readers.first_source(spark, sources[:2], "a int", spark.createDataFrame([(1,)], "a int"), whole=True).first()["source_mode"] == "synthetic_fallback"


def test_nested_columns_are_flattened(spark):
    kind = "q struct<text: string>, alt string, n array<int>, context array<struct<title: string, sentences: array<string>>>"
    rows = [(("hi",), "x", [1, None, 2], [("t", ["a", "b"]), ("u", None), ("v", []), ("w", ["c", None])]), (("",), "x", None, None), (None, None, [], [])]
    df = spark.createDataFrame(rows, kind)
    got = df.select(*[readers.flat_text(df, p).alias(p.replace(".", "_")) for p in ("q.text", "n", "context.sentences", "context.title")]).collect()
    assert [tuple(r) for r in got] == [("hi", "1 2", "a b c", "t u v w"), ("", "", "", ""), ("", "", "", "")]
    a = readers.adapt_nested(df, ["q.text", "alt"], ["alt", "context.sentences"], "s", "d").select("query_text", "context_text").collect()
    assert [tuple(r) for r in a] == [("hi", "x a b c"), ("x", "x "), ("", " ")]
    with pytest.raises(ValueError):
        readers.flat_text(df, "alt.text")


A = scenarios.Partition("a", [("1", "x", "{w} and {v}"), ("2", "y", "{w} {marker}"), ("3", "x", "fixed")], {"w": ["p", "q"], "v": ["r", "s", "t"]}, "M")


def test_scenarios_by_number(spark):
    labels = spark.createDataFrame([("x", 1)], "scenario string, tier int")
    got = {r["i"]: (r["template_id"], r["query_text"], r["tier"]) for r in scenarios.generate(spark.range(200_000, numPartitions=3).select(F.col("id").alias("i")).where("i < 60 or i > 199990"), A, labels).collect()}
    want, seen = {}, set()
    for i in [*range(60), *range(199_991, 200_000)]:
        t = A.templates[i % 3]
        text = t[2].replace("{w}", A.lexicon["w"][i // 3 % 2]).replace("{v}", A.lexicon["v"][i // 3 % 3]).replace("{marker}", f"[M_{i:05d}]")
        if text not in seen:
            want[i] = (t[0], text, 1 if t[1] == "x" else None)
        seen.add(text)
    assert got == want


def test_partitions_that_overlap_are_refused():
    b = scenarios.Partition("b", [("1", "x", "other {w}")], {"w": ["q", "z"], "v": ["u"]}, "M")
    assert scenarios.overlaps(A, b) == [("templates", []), ("lexicon v", []), ("lexicon w", ["q"]), ("marker", ["M"])]
    with pytest.raises(ValueError, match="lexicon w: q; marker: M"):
        scenarios.refuse_overlap(A, b)


def test_leakage_with_a_hot_key(spark):
    r = random.Random(4)
    rows = [(i, f"k{r.randrange(60)}" if i % 3 else "hot", r.choice(["train", "test", "validation", None])) for i in range(900)] + [(1000, None, "test"), (1001, None, "train")]
    df = spark.createDataFrame(rows, "id long, key string, split string")
    got = {(x["kind"], x["split_a"], x["split_b"]): (x["n"], x["examples"]) for x in groups.leakage(df, {"key": F.col("key"), "id": F.col("id")}, "split").collect()}
    sets = {}
    for _, k, s in rows:
        if k and s:
            sets.setdefault(k, set()).add(s)
    want = {}
    for a, b in itertools.combinations(["test", "train", "validation"], 2):
        both = sorted(k for k, v in sets.items() if {a, b} <= v)
        want["key", a, b] = (len(both), both[:5])
    assert got == want


def test_reconciliation_finds_what_is_lost(spark):
    raw = spark.range(100)
    marked = spark.range(90).withColumn("is_duplicate", F.col("id") % 9 == 0)
    splits = spark.range(80).select(F.when(F.col("id") < 50, "train").otherwise("test").alias("split"), F.when(F.col("id") != 60, "d").alias("domain"))
    check = lambda removed, s: {r["check"]: (r["expected"], r["actual"], r["ok"]) for r in groups.reconcile(raw, marked, removed, marked, s, "domain").collect()}
    assert check(10, splits) == {"raw_equals_cleaned_plus_removed": (90, 90, True), "cleaned_equals_unique_plus_duplicates": (90, 90, True), "splits_equal_unique": (80, 80, True), "train_domains_equal_total": (50, 50, True), "test_domains_equal_total": (30, 29, False)}
    lossy = check(9, splits.limit(0))
    assert lossy["raw_equals_cleaned_plus_removed"] == (91, 90, False) and lossy["splits_equal_unique"] == (80, 0, False) and len(lossy) == 3


def test_source_fingerprints_follow_the_rows(spark):
    df = spark.createDataFrame([(1, "a", "train", None), (2, "a", "test", "x"), (3, "b", "test", "y")], "id long, source string, split string, text string")
    of = lambda d: {r["source"]: (r["fingerprint"], r["splits"], r["over_budget"]) for r in groups.source_audit(d, "source", "split", 1).collect()}
    one, other = of(df), of(df.repartition(3).withColumn("text", F.when(F.col("id") == 3, "z").otherwise(F.col("text"))))
    assert one["a"] == other["a"] and one["b"][0] != other["b"][0] and one["a"][1:] == ("test,train", True)


def plain_scores(entities, shift=0.0, times=1):
    """(max, weighted, ds, ignorance) of (tier, confidence, weight, group)."""
    e = [(t, min(1, max(0, c + shift)), w * times, g) for t, c, w, g in entities]
    total = sum(w for *_, w, _ in e)
    mass = None
    for g in ("x", "y"):
        mine = [x for x in e if x[3] == g]
        if not mine:
            continue
        own = dict.fromkeys(range(1, 16), 0.0)
        for t, c, w, _ in mine:
            own[1 << t] += w * c / sum(x[2] for x in mine)
            own[15] += w * (1 - c) / sum(x[2] for x in mine)
        if mass is None:
            mass = own
            continue
        out, conflict = dict.fromkeys(range(1, 16), 0.0), 0.0
        for (a, p), (b, q) in itertools.product(mass.items(), own.items()):
            if a & b:
                out[a & b] += p * q
            else:
                conflict += p * q
        mass = {15: 1.0} if conflict >= 1 - 1e-8 else {k: v / (1 - conflict) for k, v in out.items()}
    score = sum(v / k.bit_count() * ((k >> 1 & 1) / 3 + (k >> 2 & 1) * 2 / 3 + (k >> 3 & 1)) for k, v in mass.items())
    return max(t / 3 * c for t, c, *_ in e), sum(t / 3 * c * w for t, c, w, _ in e) / total, score, mass.get(15, 0.0)


def test_scores_by_method_and_scenario(spark):
    r = random.Random(6)
    records = {i: [(r.randrange(4), r.choice([0.0, 0.05, 0.5, 0.93, 1.0]), r.choice([1.0, 2.5]), r.choice("xxy")) for _ in range(r.randint(1, 5))] for i in range(60)}
    records[100] = [(0, 1.0, 1.0, "x"), (3, 1.0, 1.0, "y")]  # in full conflict
    df = spark.createDataFrame([(i, *e) for i, es in records.items() for e in es], "record long, tier int, confidence double, w double, grp string")
    rows = risk.method_scores(df, "record", ("x", "y"), risk.SCENARIOS)
    got = {(x["record"], x["scenario"], x["method"]): x for x in rows.collect()}
    assert len(got) == 61 * 4 * 3
    for (i, s, m), x in got.items():
        want = plain_scores(records[i], *risk.SCENARIOS[s])
        assert abs(x["score"] - want[("max", "weighted", "ds").index(m)]) < 1e-9, (i, s, m)
        if m == "ds":
            assert abs(x["ignorance"] - want[3]) < 1e-9
    assert got[100, "base", "ds"]["ignorance"] == 1.0 and got[100, "base", "ds"]["conflict"] == 1.0
    for x in risk.sensitivity(rows, "record").collect():
        changes = [abs(got[i, x["scenario"], x["method"]]["score"] - got[i, "base", x["method"]]["score"]) for i in records]
        assert abs(x["mean_change"] - sum(changes) / len(changes)) < 1e-9 and abs(x["max_change"] - max(changes)) < 1e-9
        assert x["scenario"] != "twice" or x["max_change"] < 1e-9


def test_plan_of_a_nested_order():
    sig = [(("a", "b"), ("3", "g3")), (("b",), ("1", "g1")), (("c",), ("2", "g2")), (("a",), ("0", "g0")), (("d",), ("9", "g9"))]
    plan = {t: (r, n) for t, r, n in allocation.plan_order(sig, {"a": 20, "b": 30, "c": 40, "d": 3}, 10)}
    assert plan == {("a", "b"): (False, None), ("b",): (False, 1), ("c",): (False, 2), ("a",): (False, 0), ("d",): (True, None)}


@pytest.mark.parametrize("tied", [False, True])
def test_one_row_of_a_key_is_first(spark, tied):
    rows = [(i, "hot" if i % 3 else None, 0 if tied else i) for i in range(3000)] + [(9000, "one", 5)]
    done = first_of_key(spark.createDataFrame(rows, "id long, k string, o long").repartition(7), F.col("k"), [F.col("o")], "first")
    firsts = done.where("first").collect()
    assert done.count() == 3001 and sorted(str(r["k"]) for r in firsts) == ["None", "hot", "one"]
    if not tied:
        assert {r["k"]: r["id"] for r in firsts} == {"hot": 1, None: 0, "one": 9000}


def test_labels_are_held_against_splits(spark):
    labels = spark.createDataFrame([(i, "a", [0.5, 0.5] if i else [1.0]) for i in range(8)] + [(100, "a", [0.1, 0.9]), (3, "b", [1.0, 0.0, 0.0])], "record_id long, dimension string, probabilities array<double>")
    splits = spark.createDataFrame([(i, "train" if i < 6 else "test") for i in range(8)] + [(50, "train")], "record_id long, split string")
    got = {r["dimension"]: tuple(r)[1:] for r in groups.alignment_audit(labels, splits, {"a": 2, "b": 3}).collect()}
    assert got == {"a": (9, 1, 2, False, 6, 0, 2, 1, 1), "b": (1, 3, 3, True, 1, 0, 0, 0, 6)}
