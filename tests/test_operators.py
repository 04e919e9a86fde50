"""Known answers and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from veilmark.functions import probs as P
from veilmark.functions.text import cleaned, contains_any, hash_unit
from veilmark.operators import corpus, cues, evidence, groups, labeling, labelmodel, metrics, risk, spans
from veilmark.operators import components as cc
from veilmark.sources import manifest, readers
from veilmark.streaming import incremental


def one(df):
    return df.first()


def test_cleaning(spark):
    df = spark.createDataFrame([("hello    \n  world\t!",), (None,), ("a  b",), ("ﬁne",)], "t string")
    assert [r[0] for r in df.select(cleaned("t")).collect()] == ["hello world !", "", "a b", "fine"]


def test_terms_and_hash(spark):
    df = spark.createDataFrame([("shopping",), ("a pin",)], "t string")
    assert [tuple(r) for r in df.select(contains_any(F.col("t"), ["pin"]), contains_any(F.col("t"), ["pin"], True)).collect()] == [(True, False), (True, True)]
    assert 0 <= one(df.select(hash_unit("t")))[0] < 1


def test_patterns(spark):
    t = "mail a@b.co or +1 415-555-0123, paid $5,200 on 2024-01-02 for AC-123456 see https://x.y"
    m = one(spark.createDataFrame([(t,)], "t string").select(evidence.pattern_matches(F.col("t"))))[0]
    assert set(m) == {"email", "phone", "money", "date", "account_number", "url"} and m["email"] == ["a@b.co"]
    o = one(spark.createDataFrame([("My é password: hunter2",)], "t string").select(evidence.offset_matches("t")))[0]
    found = {x["name"]: (x["start"], x["end"]) for x in o}
    assert found["credential"] == (5, 22) and found["personal_reference"] == (0, 2)


def test_dedup(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "id long, t string")
    flagged = corpus.dedup_flag(df, F.lower("t"), [F.col("id")])
    assert tuple(one(corpus.dedup_stats(flagged)))[:3] == (3, 2, 1)


def test_splits_do_not_depend_on_order(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3)
    a = corpus.stratified_split(df, "g", "id", "s")
    b = corpus.stratified_split(df.repartition(7).orderBy(F.desc("id")), "g", "id", "s")
    assert a.exceptAll(b).isEmpty() and {r[0] for r in a.select("split").distinct().collect()} == {"train", "validation", "test"}


def test_global_rank(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 7919 % 503)
    r = corpus.global_rank(df, ["x"])
    assert [x["rank"] for x in r.orderBy("x").collect()] == list(range(1, 501))


def test_components(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203)]
    for limit in (500_000, 9):
        monkeypatch.setattr(cc, "TASK_EDGES", limit)
        got = {r["node"]: r["component"] for r in cc.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert cc.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_groups_and_quarantine(spark):
    df = spark.createDataFrame([(1, "x", "g1", "train"), (2, "X", "g2", "train"), (3, "y", "g2", "test"), (4, "z", None, "train")], "id long, t string, g string, split string")
    c = groups.key_components(df, "id", [F.lower("t"), F.col("g")])
    assert {r["id"]: r["component"] for r in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    q = groups.quarantine(c.join(df, "id"), "component", "split")
    assert [(r["component"], r["splits"]) for r in q.collect()] == [(1, "test,train")]
    d = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "t string, s string")
    assert groups.contradictory(d, F.col("t"), F.col("s")).count() == 1


def test_votes_and_guard(spark):
    df = spark.createDataFrame([(5,), (-3,), (1,), (None,)], "v int")
    assert [r[0] for r in df.select(labeling.guarded(F.col("v"), 3)).collect()] == [-1, -1, 1, -1]
    rec = spark.createDataFrame([(1, "general_qa", "What is my salary?", "")], "id long, domain string, query_text string, context_text string")
    m = one(labeling.vote_matrix(evidence.add_evidence(corpus.clean_records(rec, nfkc=False))))
    assert m["votes_sensitivity"][1] == 1 and m["votes_intent"][2] == 3 and m["votes_disclosure_scope"][4] == 0


def test_user_labeling_function(spark):
    @labeling.labeling_function("sensitivity", "mine")
    def mine():
        return F.lit(7)

    found, k = labeling.functions_of("sensitivity")
    labeling._registry.clear()
    assert list(found)[-1] == "mine" and k == 3


def test_label_model_matches_plain_em(spark):
    votes = [[2, 2, -1], [2, -1, 0], [-1, -1, -1], [0, 0, 0], [2, 2, -1], [1, 0, 0]] * 3
    k, m = 3, 3
    theta = [0.7] * m
    for _ in range(8):
        post = []
        for v in votes:
            nu = [1 / k] * k
            for j, x in enumerate(v):
                if x >= 0:
                    nu = [p * (theta[j] if c == x else (1 - theta[j]) / (k - 1)) for c, p in enumerate(nu)]
            post.append([p / sum(nu) for p in nu])
        theta = [min(0.99, max(0.05, sum(p[v[j]] for p, v in zip(post, votes) if v[j] >= 0) / sum(v[j] >= 0 for v in votes))) for j in range(m)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "id long, votes array<int>")
    patterns, fit = labelmodel.fit(df, "votes", m, k)
    got = {r["id"]: r["probabilities"] for r in labelmodel.apply(df, "votes", patterns).collect()}
    assert all(abs(a - b) < 1e-9 for i, p in enumerate(post) for a, b in zip(got[i], p))
    assert all(abs(a - b) < 1e-9 for a, b in zip(fit["theta"], theta))


def test_unanimous_fallback(spark):
    df = spark.createDataFrame([([2, 2],), ([2, -1],), ([-1, -1],)], "v array<int>").withColumn("p", F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)))
    got = [r[0] for r in df.select(labeling.unanimous_fallback(F.col("v"), F.col("p"), [2], 3)).collect()]
    assert got == [[0, 0, 1], [0, 0, 1], [0.2, 0.3, 0.5]]


def test_cues(spark):
    q = ["What does my HbA1c result mean?", "Why was my account debited?", "What is diabetes?", "The blood bank said I am anemic."]
    df = cues.add_cues(spark.createDataFrame([(i, x) for i, x in enumerate(q)], "id long, query_text string"))
    rows = df.select("id", F.array(*cues.cue_votes("privacy_relevant_intent").values()).alias("i"), F.array(*cues.cue_votes("sensitivity").values()).alias("s")).orderBy("id").collect()
    assert 2 in rows[0]["i"] and 3 in rows[1]["i"] and 0 in rows[2]["s"] and 3 not in rows[3]["i"]


def test_token_offsets(spark):
    df = spark.createDataFrame([(["Mayor", "##ess", ",", "here"], "Mayoress, here"), (["a", "c"], "a b c")], "w array<string>, t string")
    a, b = (r[0] for r in df.select(spans.token_offsets("w", "t")).collect())
    assert list(zip(a["starts"], a["ends"])) == [(0, 5), (5, 8), (8, 9), (10, 14)] and b["error"]


def test_entity_runs(spark):
    rows = [(1, i, x) for i, x in enumerate(["B-NAME", "I-NAME", "O", "I-NAME", "B-NAME", "I-AGE"])]
    got = spans.entity_runs(spark.createDataFrame(rows, "r long, i int, l string"), "r", "i", "l")
    assert sorted((x["type"], x["first"], x["last"], x["repaired"]) for x in got.collect()) == [("AGE", 5, 5, 1), ("NAME", 0, 1, 0), ("NAME", 3, 3, 1), ("NAME", 4, 4, 0)]


def test_alignment(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 9), (1, 2, 10, 14)], "record long, idx int, start int, end int")
    s = spark.createDataFrame([(1, 0, 9, "N"), (1, 12, 14, "X")], "record long, start int, end int, type string")
    got = [(r["label"], r["masked"]) for r in spans.bio_labels(tokens, s).orderBy("idx").collect()]
    assert got == [("B-N", False), ("I-N", False), (None, True)]


def test_span_checks(spark):
    df = spark.createDataFrame([([(0, 2, "A"), (1, 3, "B")],), ([(0, 9, "A")],), ([(0, 2, "A"), (2, 3, "B")],), ([(0, 1, None)],)], "s array<struct<start:int,end:int,type:string>>")
    assert [r[0] for r in df.select(spans.span_errors(F.col("s"), F.lit("abc"))).collect()] == ["overlap", "range", None, "type"]


def test_rebuilt_text(spark):
    df = spark.createDataFrame([(["a", "bc", "."], [True, False, False])], "t array<string>, b array<boolean>")
    r = one(df.select(spans.rebuilt_text(F.col("t"), F.col("b")), spans.running_offsets(F.col("t"), F.col("b"))))
    assert r[0] == "a bc." and r[1] == [0, 2, 4]


def test_windows_cover_every_token(spark):
    df = spark.createDataFrame([([3, 3, 9, 1, 1],), ([],)], "n array<int>")
    a, b = (r[0] for r in df.select(spans.windows(F.col("n"), 6)).collect())
    assert [(w["first"], w["last"], w["size"]) for w in a] == [(0, 1, 6), (2, 2, 6), (3, 4, 2)] and b == []


@pytest.mark.parametrize("attack", spans.ATTACKS)
def test_attacks_keep_spans(spark, attack):
    text = "call +1 415 or mail a.b@c.de now"
    df = spark.createDataFrame([(1, text, [(5, 11, "PHONE"), (20, 28, "EMAIL")])], "id long, t string, s array<struct<start:int,end:int,type:string>>")
    got = spans.attack_records(df, "id", "t", "s", [attack]).collect()
    for r in got:
        assert r["text"].startswith("call ") and r["text"].endswith(" now")
        middle = r["text"][r["spans"][0]["end"] : r["spans"][1]["start"]]
        assert middle == " or mail "
    assert len(got) == (0 if attack == "none" else 1)


def test_strict_scores(spark):
    g = spark.createDataFrame([(1, 0, 5, "N")], "r long, s int, e int, t string")
    wrong = spark.createDataFrame([(1, 0, 6, "N")], g.schema)
    assert one(spans.prf(spans.match_spans(g, wrong, ["r", "s", "e", "t"]), []))["f1"] == 0
    assert one(spans.prf(spans.match_spans(g, g, ["r", "s", "e", "t"]), []))["f1"] == 1


def test_reliability(spark):
    df = spark.createDataFrame([(0, [0.8, 0.2], 0), (1, [0.2, 0.8], 1)], "id long, p array<double>, y int")
    t = one(metrics.token_scores(df, "p", "y"))
    assert abs(t["nll"] + math.log(0.8)) < 1e-12 and abs(t["brier"] - 0.08) < 1e-12
    conf = df.withColumns({"c": F.array_max("p"), "ok": P.argmax(F.col("p")) == F.col("y")})
    assert abs(one(metrics.ece(conf, F.col("c"), F.col("ok")))["ece"] - 0.2) < 1e-12
    err = conf.withColumns({"e": ~F.col("ok"), "u": 1 - F.col("c")})
    assert one(metrics.aurc(err, "e", "u", ["id"]))["aurc"] == 0 and one(metrics.roc_auc(err.withColumn("l", F.col("e").cast("int")), "l", "u"))["auc"] is None
    assert [(r["outcome"], r["n"]) for r in metrics.by_correctness(conf, F.col("ok"), {"c": F.col("c")}).orderBy("outcome").collect()] == [("correct", 2), ("incorrect", 0)]


def test_temperature_cools_overconfidence(spark):
    rows = [(i, [math.log(0.99), math.log(0.01)], int(i >= 7)) for i in range(10)]
    t = metrics.fit_temperature(spark.createDataFrame(rows, "id long, z array<double>, y int"), "z", "y")
    assert t > 1
    assert metrics.fit_temperature(spark.createDataFrame([], "id long, z array<double>, y int"), "z", "y") == 1.0


def test_draws(spark):
    d = spark.createDataFrame([(1, 0, [0.2, 0.8]), (1, 1, [0.6, 0.4])], "id long, p long, probs array<double>")
    r = one(metrics.draws_summary(d, ["id"]))
    assert [round(x, 9) for x in r["mean"]] == [0.4, 0.6] and abs(r["variance"][0] - 0.04) < 1e-12 and r["mutual_information"] > 0


def test_dempster(spark):
    df = spark.createDataFrame([({1: 0.6, 15: 0.4}, {1: 0.5, 15: 0.5}), ({1: 1.0}, {8: 1.0})], "a map<int,double>, b map<int,double>")
    x, y = (r[0] for r in df.select(risk.combine(F.col("a"), F.col("b"))).collect())
    assert abs(x["mass"][1] - 0.8) < 1e-12 and x["conflict"] == 0 and not x["failed"]
    assert y["mass"] == {15: 1.0} and y["conflict"] == 1 and y["failed"]
    m = spark.createDataFrame([({1: 0.4, 3: 0.2, 15: 0.4},)], "m map<int,double>")
    s = one(m.select(*[c.alias(n) for n, c in risk.belief_summary(F.col("m")).items()]))
    assert s["belief_low"] == 0.4 and abs(s["plausibility_low"] - 1) < 1e-12 and abs(sum(s[f"p_{t}"] for t in ("low", "medium", "high", "critical")) - 1) < 1e-12
    bad = spark.createDataFrame([({0: 1.0},), ({1: 0.5},), ({1: 1.0},)], "m map<int,double>")
    assert [r[0] for r in bad.select(risk.mass_error(F.col("m"))).collect()] == ["mask", "sum", None]


def test_policies(spark):
    assert risk.candidates(spark, [1, 2], [0.5, 1], [["*"]]).count() == 4
    with pytest.raises(ValueError):
        risk.candidates(spark, [0], [1], [["*"]])
    p = spark.createDataFrame([("weak", 0.6, ["*"]), ("medium", 0.8, ["*"]), ("strong", 1.0, ["*"])], "policy_id string, coverage double, protected_types array<string>")
    f = spark.createDataFrame([("weak", 0.35, 0.95, 2.0), ("medium", 0.65, 0.85, 5.0), ("strong", 0.95, 0.7, 12.0)], "policy_id string, privacy double, utility double, latency_ms double")
    r = spark.createDataFrame([(1, 0.4, 0.0, 0.0, ["A"]), (2, 0.99, 0.0, 0.0, ["A"])], "record_id long, score double, uncertainty double, ignorance double, entity_types array<string>")
    got = {x["record_id"]: (x["policy_id"], x["action"]) for x in risk.choose(r, p, f, 0.5, 0.6, 20).collect()}
    assert got == {1: ("medium", "apply_policy"), 2: (None, "block")}
    assert one(risk.choose(r.where("record_id = 1"), p, f, 0.5, 0.6, 20, fixed="weak"))["action"] == "block"


def test_risk_fallback_raises_a_level(spark):
    dims = {"sensitivity": [0.1, 0.1, 0.8], "intent": [0.9, 0, 0, 0, 0.1], "disclosure_scope": [0.9, 0.1], "entity_tags": [0.1, 0.5, 0.2, 0.1], "threat_content": [0.4, 0.3, 0.3]}
    row = spark.range(1).withColumns({f"{d}_mean": F.array(*[F.lit(float(x)) for x in v]) for d, v in dims.items()} | {f"{d}_entropy": F.lit(0.8) for d in dims})
    r = one(risk.risk_decisions(row))
    assert r["risk_score"] == 0.3 and r["fallback_applied"] and r["risk_level"] == "high" and r["rules"][-1] == "uncertainty_fallback"


def test_manifest_refuses_changes(spark, tmp_path):
    df = spark.range(10)
    m = str(tmp_path / "manifest")
    manifest.write_stage(df, str(tmp_path / "a"), m, "a", {"x": 1})
    assert manifest.verify_stage(spark, m, "a", {"x": 1}).count() == 10
    with pytest.raises(ValueError):
        manifest.verify_stage(spark, m, "a", {"x": 2})
    spark.range(11).write.mode("overwrite").parquet(str(tmp_path / "a"))
    with pytest.raises(ValueError):
        manifest.verify_stage(spark, m, "a", {"x": 1})
    with pytest.raises(ValueError):
        manifest.refuse_sealed(spark.createDataFrame([("test",)], "split string"))


def test_readers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(p), "a int").count() == 2
    got = readers.first_source(spark, [("real_local", str(tmp_path / "none")), ("real_cached", str(p))], "a int")
    assert one(got)["source_mode"] == "real_cached"
    with pytest.raises(FileNotFoundError):
        readers.first_source(spark, [("real_local", str(tmp_path / "none"))], "a int")
    import hashlib

    good = {"x.jsonl": hashlib.sha256(p.read_bytes()).hexdigest()}
    assert len(readers.checked_files(spark, str(p), good)) == 1
    with pytest.raises(ValueError):
        readers.checked_files(spark, str(p), {"x.jsonl": "0"})


def test_stream_equals_batch(spark, tmp_path):
    schema = "record_id long, domain string, query_text string, context_text string"
    rows = [(i, "general_qa", f"What is my salary {i}?", "") for i in range(20)]
    src, sink, progress = (str(tmp_path / x) for x in ("src", "sink", "progress"))
    df = spark.createDataFrame(rows, schema)
    df.where("record_id < 10").write.parquet(src)
    incremental.run(spark, src, sink, progress, schema, ["sensitivity"])
    df.where("record_id >= 10").write.mode("append").parquet(src)
    incremental.run(spark, src, sink, progress, schema, ["sensitivity"])
    got, want = spark.read.parquet(sink).select("record_id", "votes_sensitivity"), incremental.label(df, ["sensitivity"]).select("record_id", "votes_sensitivity")
    assert got.count() == 20 and got.exceptAll(want).isEmpty()


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
