"""Queries over sinks, streams and the remaining joins and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilmark.functions.text import filled, normalised
from veilmark.operators import corpus, evidence, labeling, metrics, spans
from veilmark.operators import risk as R
from veilmark.plans.data import _SPLIT, docs, split
from veilmark.plans.fixtures import EV, GAZETTEER, TQ, VOTES, records, table, tq, votes_cte
from veilmark.plans.registry import query
from veilmark.plans.scores import _ENT, _P10, _RISK, decisions, entities, probs
from veilmark.plans.spans import _BOTH, gold, sides
from veilmark.scratch import checkpoint_dir, cut, drop
from veilmark.sources import readers
from veilmark.streaming import incremental


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _kept(out, *paths):
    """``out`` materialised, so that the folders that it was read from can go."""
    out = cut(out)
    for path in paths:
        drop(out.sparkSession, path)
    return out


@query("a01_json_lines", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents")
def a01(spark, sf):
    path = _folder(spark, "jsonl")
    docs(spark, sf).select("doc_id", "text").write.json(path)
    back = readers.read_jsonl(spark, path, "doc_id long, text string")
    return _kept(back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"), F.sum(F.length(filled("text"))).alias("chars")), path)


@query("a06_source_precedence", "SELECT 'real_local' AS source_mode, count(*) AS n FROM documents")
def a06(spark, sf):
    got = readers.first_source(spark, [("real_cached", f"{sf}/no_such_table.parquet"), ("real_local", f"{sf}/documents.parquet")])
    return got.groupBy("source_mode").agg(F.count(F.lit(1)).alias("n"))


@query("a14_split_sink", f"WITH {_SPLIT} SELECT split, count(*) AS n FROM sp GROUP BY split")
def a14(spark, sf):
    path = _folder(spark, "splits")
    readers.write_splits(split(spark, sf).select("doc_id", "split"), path)
    return _kept(spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n")), path)


@query("a15_weak_label_sink", "WITH " + EV + " SELECT t AS dimension, count(*) AS n FROM ev, (VALUES ('intent'), ('sensitivity')) AS x(t) GROUP BY t")
def a15(spark, sf):
    path = _folder(spark, "labels")
    m = labeling.vote_matrix(records(spark, sf), ["sensitivity", "intent"])
    rows = [F.struct(F.lit(t).alias("dimension"), labeling.majority(F.col(f"votes_{t}"), len(labeling.TAXONOMY[t])).alias("probabilities")) for t in ("sensitivity", "intent")]
    readers.write_splits(m.select("record_id", F.explode(F.array(*rows)).alias("x")).select("record_id", "x.*"), path, by="dimension")
    return _kept(spark.read.parquet(path).groupBy("dimension").agg(F.count(F.lit(1)).alias("n")), path)


@query("b01_missing_text", "SELECT count(*) FILTER (WHERE coalesce(text, '') = '') AS empty FROM documents")
def b01(spark, sf):
    return docs(spark, sf).agg(F.count_if(filled("text") == "").alias("empty"))


@query("b02_nfkc", "SELECT doc_id, md5(nfkc) AS digest FROM (SELECT doc_id, coalesce(text, '') AS nfkc FROM documents)")
def b02(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(normalised("text")).alias("digest"))


@query("b19_canonical_spans", f"{_BOTH} SELECT record, string_agg(s || ':' || CASE type WHEN 'A' THEN 'ALPHA' ELSE type END, ',' ORDER BY s) AS spans FROM gold GROUP BY record")
def b19(spark, sf):
    g = gold(spark, sf).groupBy("record").agg(F.collect_list(F.struct(F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"), "type")).alias("raw"))
    s = spans.canonical(F.col("raw"), {"A": "ALPHA"})
    return g.select("record", F.array_join(F.transform(s, lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["type"])), ",").alias("spans"))


@query("d07_clean_attacked_pairs", f"{_BOTH} SELECT count(*) AS pairs, count(*) FILTER (WHERE g.e = p.e AND g.type = p.type) AS same FROM gold g JOIN pred p ON g.record = p.record AND g.s = p.s")
def d07(spark, sf):
    g, p = sides(spark, sf)
    p = p.withColumnsRenamed({"e": "pe", "type": "pt"}).select("record", "s", "pe", "pt")
    j = g.join(p.hint("merge"), ["record", "s"])
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.count_if((F.col("e") == F.col("pe")) & (F.col("type") == F.col("pt"))).alias("same"))


@query("d11_policy_observations", "SELECT policy_id, round(min(1 - o_totalprice::DOUBLE / 1000000 / s), 6) AS privacy, round(max(s * length(o_orderpriority)), 6) AS latency_ms, count(*) AS n FROM orders, (VALUES ('weak', 1.0::DOUBLE), ('strong', 3.0)) AS x(policy_id, s) GROUP BY policy_id")
def d11(spark, sf):
    """Orders are the cases; each is seen under each policy, and policies are profiled by the worst seen."""
    runs = spark.createDataFrame([("weak", 1.0), ("strong", 3.0)], "policy_id string, s double")
    seen = table(spark, sf, "orders").crossJoin(F.broadcast(runs))
    seen = seen.select("policy_id", (1 - F.col("o_totalprice").cast("double") / 1000000 / F.col("s")).alias("privacy"), F.lit(1.0).alias("utility"), (F.col("s") * F.length("o_orderpriority")).alias("latency_ms"), F.lit("measured").alias("provenance"))
    return R.profile(seen).select("policy_id", F.round("privacy", 6).alias("privacy"), F.round("latency_ms", 6).alias("latency_ms"), "n")


@query("d14_config_lookup", f"WITH {TQ}, s(domain, tier) AS (VALUES ('medical', 2), ('financial', 1)) SELECT record_id, coalesce(tier, 0) AS tier FROM tq LEFT JOIN s USING (domain)")
def d14(spark, sf):
    tiers = spark.createDataFrame([("medical", 2), ("financial", 1)], "domain string, tier int")
    return tq(spark, sf).join(F.broadcast(tiers), "domain", "left").select("record_id", F.coalesce("tier", F.lit(0)).alias("tier"))


@query("f09_quarter_subsets", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws('|', 'v1', doc_id::VARCHAR))) AS k, count(*) OVER () AS n FROM documents WHERE lang = 'en') SELECT f AS fraction, count(*) AS n FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) AS t(f) WHERE k <= ceil(n * f) GROUP BY f")
def f09(spark, sf):
    s = corpus.nested_subsets(docs(spark, sf).where("lang = 'en'"), "doc_id", "v1", [0.25, 0.5, 0.75, 1.0])
    return s.groupBy("fraction").agg(F.count(F.lit(1)).alias("n"))


@query("g06_contract_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws('|', 'o', doc_id::VARCHAR)), doc_id) AS rank FROM documents")
def g06(spark, sf):
    d = docs(spark, sf).select("doc_id").withColumn("digest", F.sha2(F.concat_ws("|", F.lit("o"), F.col("doc_id").cast("string")), 256))
    return corpus.global_rank(d, ["digest", "doc_id"]).select("doc_id", "rank")


@query("i10_soft_target_ece", f"WITH {_P10}, x AS (SELECT conf, CASE WHEN best = label THEN 0.8 ELSE 0.1 END AS mass FROM bs WHERE label <> 9), b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, sum(conf) AS c, sum(mass) AS a FROM x GROUP BY ALL) SELECT round(sum(abs(c - a)) / sum(n), 7) AS ece FROM b")
def i10(spark, sf):
    mass = F.when(F.col("best") == F.col("label"), 0.8).otherwise(0.1)
    return metrics.ece(probs(spark, sf).where("label <> 9"), F.col("conf"), mass).select(F.round("ece", 7).alias("ece"))


@query("i22_candidate_report", f"WITH {_P10} SELECT 'nll' AS metric, round(avg(-ln(greatest(p[label + 1], 1e-12))), 7) AS value FROM bs UNION ALL SELECT 'accuracy', round(avg((label = best)::INT), 7) FROM bs")
def i22(spark, sf):
    p = probs(spark, sf)
    nll = metrics.token_scores(p, "p", "label").select(F.lit("nll").alias("metric"), F.round("nll", 7).alias("value"))
    return nll.unionByName(metrics.single_label(p, "label", "best").select(F.lit("accuracy").alias("metric"), F.round("accuracy", 7).alias("value")))


@query("k03_uncertainty_fallback", f"WITH {_RISK} SELECT risk_level, fallback_applied, count(*) AS n FROM dc GROUP BY ALL")
def k03(spark, sf):
    return decisions(spark, sf).groupBy("risk_level", "fallback_applied").agg(F.count(F.lit(1)).alias("n"))


@query("k16_decisions_by_method", f"WITH {_ENT}, s AS (SELECT record, max(tier / 3 * c) AS a, sum(tier / 3 * c * w) / sum(w) AS b FROM en GROUP BY record) SELECT 'max' AS method, count(*) FILTER (WHERE round(a, 9) > 0.8) AS blocked FROM s UNION ALL SELECT 'weighted', count(*) FILTER (WHERE round(b, 9) > 0.8) FROM s")
def k16(spark, sf):
    """Scores of exactly 0.8 occur and are not blocked; nine decimals hold them still, in whatever order a record's rows are summed."""
    e = entities(spark, sf).withColumns({"tier": F.when(F.col("type") == "A", 3).when(F.col("type") == "N", 1).otherwise(2), "w": F.when(F.col("type") == "A", 2.0).otherwise(1.0)})
    s = R.baseline_scores(e, "record")
    long = s.select(F.explode(F.array(F.struct(F.lit("max").alias("method"), F.col("max_score").alias("v")), F.struct(F.lit("weighted").alias("method"), F.col("weighted_score").alias("v")))).alias("x")).select("x.*")
    return long.groupBy("method").agg(F.count_if(F.round("v", 9) > 0.8).alias("blocked"))


@query("b11_annotator_plug_in", "SELECT doc_id, length(coalesce(text, '')) AS chars FROM documents")
def b11(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    return evidence.annotate(d, lambda s: s.fillna("").str.len().astype("int32"), "int", "chars", text_col="text").select("doc_id", "chars")


@query("l01_incremental_votes", f"WITH {votes_cte('sensitivity')} SELECT record_id, concat_ws(',', {', '.join(f'v{j}' for j in range(len(VOTES['sensitivity'])))}) AS votes FROM vt")
def l01(spark, sf):
    src, sink, progress = (_folder(spark, n) for n in ("stream-source", "stream-sink", "stream-progress"))
    rows = tq(spark, sf)
    for part in (0, 1):
        rows.where(F.col("record_id") % 2 == part).write.mode("append").parquet(src)
        incremental.run(spark, src, sink, progress, "record_id long, domain string, query_text string, context_text string", ["sensitivity"], GAZETTEER)
    return _kept(spark.read.parquet(sink).select("record_id", F.array_join(F.transform("votes_sensitivity", lambda v: v.cast("string")), ",").alias("votes")), src, sink, progress)
