"""Queries over model outputs made from ``embeddings`` and ``customer``: metrics, calibration, uncertainty, risk and policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.functions import probs as P
from veilmark.operators import metrics as M
from veilmark.operators import risk as R
from veilmark.plans.fixtures import table
from veilmark.plans.registry import query

R6 = lambda c, n=None: F.round(c, 6).alias(n or c)


def _softmax_sql(lo: int, k: int, scale: int = 8) -> str:
    """probabilities p0, p1, … of elements lo+1 … lo+k."""
    z = [f"exp({scale} * embedding[{lo + i + 1}]::DOUBLE)" for i in range(k)]
    total = " + ".join(z)
    return ", ".join(f"{x} / ({total}) AS p{i}" for i, x in enumerate(z))


_P10 = f"pr AS (SELECT vec_id, label, {_softmax_sql(0, 10)} FROM embeddings), ar AS (SELECT *, [{', '.join(f'p{i}' for i in range(10))}] AS p FROM pr), bs AS (SELECT vec_id, label, p, list_position(p, list_max(p)) - 1 AS best, list_max(p) AS conf FROM ar)"


def probs(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("logits", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 8))
    return e.select("vec_id", "label", "logits", P.softmax(F.col("logits")).alias("p")).withColumns({"best": P.argmax(F.col("p")), "conf": F.array_max("p")})


@query("b29_softmax", f"WITH {_P10} SELECT vec_id, " + ", ".join(f"round(p[{i + 1}], 9) AS p{i}" for i in range(10)) + " FROM bs")
def b29(spark, sf):
    return probs(spark, sf).select("vec_id", *[F.round(F.col("p")[i], 9).alias(f"p{i}") for i in range(10)])


@query("b29_log_rescaled", "WITH " + _P10 + ", w AS (SELECT vec_id, list_transform(p, lambda x: exp(ln(greatest(x, 1e-12)) / 2)) AS q FROM bs) SELECT vec_id, round(q[1] / list_sum(q), 9) AS p0 FROM w")
def b29_rescaled(spark, sf):
    return probs(spark, sf).select("vec_id", F.round(P.log_rescaled(F.col("p"), 2.0)[0], 9).alias("p0"))


@query("b30_entropies", "WITH " + _P10 + " SELECT vec_id, round(-list_sum(list_transform(p, lambda x: greatest(x, 1e-12) * ln(greatest(x, 1e-12)))), 7) AS h, round(-list_sum(list_transform(p, lambda x: greatest(x, 1e-12) * ln(greatest(x, 1e-12)))) / ln(10), 7) AS hn, round(-(p[1] * ln(p[1]) + (1 - p[1]) * ln(1 - p[1])), 7) AS hb FROM bs")
def b30(spark, sf):
    p = F.col("p")
    return probs(spark, sf).select("vec_id", F.round(P.entropy(p), 7).alias("h"), F.round(P.normalised_entropy(p), 7).alias("hn"), F.round(P.binary_entropy(p[0]), 7).alias("hb"))


@query("b32_safe_normalise", "SELECT c_custkey, CASE WHEN greatest(c_acctbal, 0) > 1e-12 THEN 0.25 ELSE 0.5 END AS p0, CASE WHEN greatest(c_acctbal, 0) > 1e-12 THEN 0.75 ELSE 0.5 END AS p1 FROM customer")
def b32(spark, sf):
    x = F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0))
    p = P.safe_normalised(F.array(x, x * 3), 2)
    return table(spark, sf, "customer").select("c_custkey", F.round(p[0], 9).alias("p0"), F.round(p[1], 9).alias("p1"))


@query("i01_single_label", "WITH " + _P10 + ", c AS (SELECT label AS y, best AS p FROM bs), k AS (SELECT DISTINCT x FROM (SELECT y AS x FROM c UNION SELECT p FROM c)), e AS (SELECT x, (SELECT count(*) FROM c WHERE y = x) AS support, (SELECT count(*) FROM c WHERE p = x) AS guessed, (SELECT count(*) FROM c WHERE y = x AND p = x) AS tp FROM k) SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(avg(2 * tp / (support + guessed)), 9) AS macro_f1, round(sum(support * 2 * tp / (support + guessed)) / sum(support), 9) AS weighted_f1 FROM e")
def i01(spark, sf):
    s = M.single_label(probs(spark, sf), "label", "best")
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


_SOFT = "sf AS (SELECT vec_id, " + ", ".join(f"1 / (1 + exp(-8 * embedding[{i + 1}]::DOUBLE)) AS s{i}" for i in range(4)) + ", " + ", ".join(f"((label >> {i}) & 1)::DOUBLE AS y{i}" for i in range(4)) + " FROM embeddings), lg AS (" + " UNION ALL ".join(f"SELECT 'c{i}' AS category, y{i} >= 0.5 AS t, s{i} >= 0.5 AS p FROM sf" for i in range(4)) + "), ct AS (SELECT category, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM lg GROUP BY category)"
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"


def soft(spark, sf):
    e = table(spark, sf, "embeddings")
    p = F.transform(F.slice("embedding", 1, 4), lambda x: P.sigmoid(x.cast("double") * 8))
    y = F.array(*[F.shiftright("label", i).bitwiseAND(F.lit(1)).cast("double") for i in range(4)])
    return e.select("vec_id", p.alias("s"), y.alias("y"))


@query("i03_multi_label", f"WITH {_SOFT}, sm AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg({_F1}) AS f FROM ct) SELECT category, tp, fp, fn, round({_F1}, 9) AS f1 FROM ct UNION ALL SELECT 'micro', tp, fp, fn, round({_F1}, 9) FROM sm UNION ALL SELECT 'macro', tp, fp, fn, round(f, 9) FROM sm")
def i03(spark, sf):
    return M.multi_label(soft(spark, sf), "y", "s", [f"c{i}" for i in range(4)]).withColumn("f1", F.round("f1", 9))


@query("i02_roc_auc", f"WITH {_P10}, x AS (SELECT (label = best)::INT AS y, round(conf, 6) AS s FROM bs), r AS (SELECT y, avg(rn) OVER (PARTITION BY s) AS rank FROM (SELECT y, s, row_number() OVER (ORDER BY s) AS rn FROM x)) SELECT round((sum(rank) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r")
def i02(spark, sf):
    d = probs(spark, sf).select((F.col("label") == F.col("best")).cast("int").alias("y"), F.round("conf", 6).alias("s"))
    return M.roc_auc(d, "y", "s").select(F.round("auc", 9).alias("auc"))


@query("i02_average_precision", f"WITH {_P10}, x AS (SELECT (label = best)::INT AS y, round(conf, 6) AS s FROM bs), g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM x GROUP BY s), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM g WINDOW w AS (ORDER BY s DESC)) SELECT round(sum(tp / al * pos) / sum(pos), 9) AS ap FROM c")
def i02_ap(spark, sf):
    d = probs(spark, sf).select((F.col("label") == F.col("best")).cast("int").alias("y"), F.round("conf", 6).alias("s"))
    return M.average_precision(d, "y", "s").select(F.round("ap", 9).alias("ap"))


_BIN = "least(floor(conf * 10), 9)::INT"


@query("i08_ece_bins", f"WITH {_P10}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(conf) AS c, avg((label = best)::INT) AS a FROM bs GROUP BY ALL) SELECT k::INT AS bin, coalesce(n, 0) AS n, round(coalesce(c, 0), 7) AS confidence, round(coalesce(a, 0), 7) AS accuracy, round(coalesce(abs(c - a), 0), 7) AS gap FROM generate_series(0, 9) AS s(k) LEFT JOIN b ON bin = k")
def i08(spark, sf):
    b = M.ece_bins(probs(spark, sf), F.col("conf"), F.col("label") == F.col("best"))
    return b.select("bin", "n", *[F.round(c, 7).alias(c) for c in ("confidence", "accuracy", "gap")])


@query("i09_ece_by_label", f"WITH {_P10}, b AS (SELECT label, {_BIN} AS bin, count(*) AS n, sum(conf) AS c, sum((label = best)::INT) AS a FROM bs GROUP BY ALL) SELECT label, round(sum(abs(c - a)) / sum(n), 7) AS ece FROM b GROUP BY label")
def i09(spark, sf):
    return M.ece(probs(spark, sf), F.col("conf"), F.col("label") == F.col("best"), by=["label"]).select("label", F.round("ece", 7).alias("ece"))


@query("i11_token_reliability", f"WITH {_P10} SELECT round(avg(-ln(greatest(p[label + 1], 1e-12))), 7) AS nll, round(avg(list_sum(list_transform(p, lambda x, i: pow(x - CASE WHEN i = label + 1 THEN 1 ELSE 0 END, 2)))), 7) AS brier, count(*) AS n FROM bs")
def i11(spark, sf):
    t = M.token_scores(probs(spark, sf), "p", "label")
    return t.select(F.round("nll", 7).alias("nll"), F.round("brier", 7).alias("brier"), "n")


@query("i11_aurc", f"WITH {_P10}, x AS (SELECT (label <> best)::INT AS e, row_number() OVER (ORDER BY round(1 - conf, 6), vec_id) AS r FROM bs), c AS (SELECT r, sum(e) OVER (ORDER BY r) AS s FROM (SELECT e, r FROM x)) SELECT round(avg(s / r), 7) AS aurc FROM c")
def i11_aurc(spark, sf):
    d = probs(spark, sf).select("vec_id", (F.col("label") != F.col("best")).alias("e"), F.round(1 - F.col("conf"), 6).alias("u"))
    return M.aurc(d, "e", "u", ["vec_id"]).select(F.round("aurc", 7).alias("aurc"))


@query("i12_by_correctness", f"WITH {_P10}, t(outcome) AS (VALUES ('correct'), ('incorrect')), x AS (SELECT CASE WHEN label = best THEN 'correct' ELSE 'incorrect' END AS outcome, conf FROM bs) SELECT outcome, count(conf) AS n, round(avg(conf), 7) AS confidence FROM t LEFT JOIN x USING (outcome) GROUP BY outcome")
def i12(spark, sf):
    return M.by_correctness(probs(spark, sf), F.col("label") == F.col("best"), {"confidence": F.col("conf")}).withColumn("confidence", F.round("confidence", 7))


_DRAWS = "dr AS (" + " UNION ALL ".join(f"SELECT vec_id, {t} AS pass, label, {_softmax_sql(10 * t, 10)} FROM embeddings" for t in range(6)) + "), dl AS (" + " UNION ALL ".join(f"SELECT vec_id, pass, {k} AS k, p{k} AS p FROM dr" for k in range(10)) + ")"


def draws(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pass"))
    logits = F.transform(F.slice("embedding", F.col("pass") * 10 + 1, F.lit(10)), lambda x: x.cast("double") * 8)
    return e.select("vec_id", "label", "pass", P.softmax(logits).alias("probs"))


@query("i13_mc_summary", f"WITH {_DRAWS} SELECT vec_id, k, round(avg(p), 7) AS mean, round(var_pop(p), 7) AS variance FROM dl GROUP BY vec_id, k")
def i13(spark, sf):
    s = M.draws_summary(draws(spark, sf), ["vec_id"])
    z = s.select("vec_id", F.posexplode(F.arrays_zip("mean", "variance")).alias("k", "x"))
    return z.select("vec_id", "k", F.round("x.mean", 7).alias("mean"), F.round("x.variance", 7).alias("variance"))


@query("i14_mutual_information", f"WITH {_DRAWS}, m AS (SELECT vec_id, sum(-m * ln(m)) AS h FROM (SELECT vec_id, k, greatest(avg(p), 1e-12) AS m FROM dl GROUP BY ALL) GROUP BY vec_id), e AS (SELECT vec_id, avg(h) AS h FROM (SELECT vec_id, pass, sum(-greatest(p, 1e-12) * ln(greatest(p, 1e-12))) AS h FROM dl GROUP BY ALL) GROUP BY vec_id) SELECT vec_id, round(m.h, 6) AS predictive_entropy, round(e.h, 6) AS expected_entropy, round(m.h - e.h, 6) AS mutual_information FROM m JOIN e USING (vec_id)")
def i14(spark, sf):
    s = M.draws_summary(draws(spark, sf), ["vec_id"])
    return s.select("vec_id", *[R6(c) for c in ("predictive_entropy", "expected_entropy", "mutual_information")])


@query("i14_variation_ratio", f"WITH {_DRAWS}, b AS (SELECT vec_id, pass, arg_max(k, p) AS best FROM dl GROUP BY vec_id, pass), s(budget) AS (VALUES (2), (4), (6)), c AS (SELECT vec_id, budget, best, count(*) AS n FROM b, s WHERE pass < budget GROUP BY ALL) SELECT vec_id, budget, round(1 - max(n) / sum(n), 9) AS variation_ratio FROM c GROUP BY vec_id, budget")
def i14_ratio(spark, sf):
    d = M.budgets(draws(spark, sf).withColumn("best", P.argmax(F.col("probs"))), "pass", [2, 4, 6])
    return M.variation_ratio(d, ["vec_id", "budget"], "best").withColumn("variation_ratio", F.round("variation_ratio", 9))


@query("i15_log_mixture_nll", f"WITH {_DRAWS}, t AS (SELECT d.vec_id, avg(p) AS m FROM dl d JOIN embeddings e ON e.vec_id = d.vec_id AND e.label = d.k GROUP BY d.vec_id) SELECT round(avg(-ln(greatest(m, 1e-12))), 7) AS nll FROM t")
def i15(spark, sf):
    d = draws(spark, sf).withColumn("p", F.col("probs")[F.col("label")])
    return M.log_mixture_nll(d, ["vec_id"], "p").select(F.round("nll", 7).alias("nll"))


def temperature_sql(heads: dict[str, int]) -> str:
    """The temperature of each head (its name and how many numbers lie before its ten logits) on ever finer grids of its logarithm."""
    z = lambda lo: "[" + ", ".join(f"8 * embedding[{lo + i + 1}]::DOUBLE" for i in range(10)) + "]"
    out = ["hd AS (" + " UNION ALL ".join(f"SELECT '{n}' AS head, vec_id, label, {z(lo)} AS l FROM embeddings" for n, lo in heads.items()) + ")"]
    out.append("hy AS (SELECT head, l, list_max(l) AS top, l[1 + CASE WHEN vec_id % 3 = 0 THEN label ELSE list_position(l, list_max(l)) - 1 END] AS y FROM hd)")
    at = "SELECT head, -3 + i * 0.05::DOUBLE AS t FROM (SELECT DISTINCT head FROM hd), generate_series(0, 120) AS g(i)"
    for k, step in enumerate((0.002, 0.00008, None)):
        out.append(f"n{k} AS (SELECT head, t, avg((top - y) / exp(t) + ln(list_sum(list_transform(l, lambda x: exp((x - top) / exp(t)))))) AS nll FROM hy JOIN ({at}) USING (head) GROUP BY head, t)")
        out.append(f"b{k} AS (SELECT head, arg_min(t, nll) AS t, min(nll) AS nll FROM n{k} GROUP BY head)")
        at = f"SELECT head, t + (i - 50) * {step}::DOUBLE AS t FROM b{k}, generate_series(0, 100) AS g(i)"
    return ", ".join(out)


def _heads(spark, sf, heads):
    """Logits and truths: of every third vector its label, else the largest logit."""
    for name, lo in heads.items():
        z = table(spark, sf, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", lo + 1, 10), lambda x: x.cast("double") * 8).alias("z"))
        yield name, z.withColumn("y", F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise(P.argmax(F.col("z"))))


@query("i16_temperature", f"WITH {temperature_sql({'only': 0})} SELECT round(exp(t), 2) AS temperature, round(nll, 6) AS nll, (SELECT count(*) FROM embeddings) AS n FROM b2")
def i16(spark, sf):
    _, z = next(_heads(spark, sf, {"only": 0}))
    t = M.fit_temperature(z, "z", "y")
    return M.token_scores(z.withColumn("p", P.softmax(F.col("z"), t)), "p", "y").select(F.lit(round(t, 2)).alias("temperature"), F.round("nll", 6).alias("nll"), "n")


@query("i19_composite_uncertainty", f"WITH {_P10} SELECT vec_id, round((-list_sum(list_transform(p, lambda x: greatest(x, 1e-12) * ln(greatest(x, 1e-12)))) / ln(10) + (1 - conf)) / 2, 7) AS composite FROM bs")
def i19(spark, sf):
    return probs(spark, sf).select("vec_id", F.round((P.normalised_entropy(F.col("p")) + (1 - F.col("conf"))) / 2, 7).alias("composite"))


@query("i20_rank_stability", f"WITH {_DRAWS}, u AS (SELECT vec_id, round(1 - max(m) FILTER (WHERE b = 2), 6) AS a, round(1 - max(m) FILTER (WHERE b = 6), 6) AS c FROM (SELECT vec_id, 2 AS b, k, avg(p) AS m FROM dl WHERE pass < 2 GROUP BY ALL UNION ALL SELECT vec_id, 6, k, avg(p) FROM dl GROUP BY ALL) GROUP BY vec_id), r AS (SELECT avg(x) OVER (PARTITION BY a) AS ra, avg(y) OVER (PARTITION BY c) AS rc FROM (SELECT a, c, row_number() OVER (ORDER BY a) AS x, row_number() OVER (ORDER BY c) AS y FROM u)) SELECT round(corr(ra, rc), 7) AS spearman FROM r")
def i20(spark, sf):
    d = M.budgets(draws(spark, sf), "pass", [2, 6])
    s = M.draws_summary(d, ["vec_id", "budget"]).withColumn("u", F.round(1 - F.array_max("mean"), 6))
    wide = s.groupBy("vec_id").pivot("budget", [2, 6]).agg(F.first("u")).withColumnsRenamed({"2": "a", "6": "c"})
    return M.rank_stability(wide, "a", "c").select(F.round("spearman", 7).alias("spearman"))


@query("i24_soft_cross_entropy", f"WITH {_P10}, z AS (SELECT vec_id, [{', '.join(f'8 * embedding[{i + 1}]::DOUBLE' for i in range(10))}] AS l FROM embeddings) SELECT round(avg(ln(list_sum(list_transform(l, lambda x: exp(x)))) - list_sum(l) / 10), 7) AS loss FROM z")
def i24(spark, sf):
    return M.soft_cross_entropy(probs(spark, sf).withColumn("t", F.array_repeat(F.lit(0.1), 10)), "t", "logits").select(F.round("loss", 7).alias("loss"))


@query("i25_candidate_stability", f"WITH {_DRAWS}, m AS (SELECT vec_id, k, avg(p) FILTER (WHERE pass < 2) AS a, avg(p) AS b FROM dl GROUP BY vec_id, k) SELECT round(avg(abs(a - b)), 7) AS mean_delta FROM m")
def i25(spark, sf):
    long = draws(spark, sf).select("vec_id", "pass", F.posexplode("probs").alias("k", "p"))
    g = long.groupBy("vec_id", "k").agg(F.avg(F.when(F.col("pass") < 2, F.col("p"))).alias("a"), F.avg("p").alias("b"))
    return g.agg(F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 7).alias("mean_delta"))


@query("i21_metric_changes", "WITH a AS (SELECT o_orderpriority AS k, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS b, avg(o_totalprice) AS c FROM orders GROUP BY ALL) SELECT k, round(b, 3) AS before, round(c, 3) AS after, round(c - b, 3) AS change, abs(c - b) <= 500 AS within FROM a")
def i21(spark, sf):
    o = table(spark, sf, "orders").withColumn("x", F.col("o_totalprice").cast("double"))
    mean = lambda d: d.groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg("x").alias("v"))
    c = M.metric_changes(mean(o.where("o_orderstatus = 'F'")), mean(o), "k", "v", 500)
    return c.select("k", *[F.round(x, 3).alias(x) for x in ("before", "after", "change")], "within")


_RISK_DIMS = (("sensitivity", 0, 3), ("intent", 3, 5), ("disclosure_scope", 8, 2), ("entity_tags", 10, 4), ("threat_content", 14, 3))
_RISK = "rk AS (SELECT vec_id, " + ", ".join(f"[{', '.join(f'1 / (1 + exp(-8 * embedding[{lo + i + 1}]::DOUBLE))' for i in range(k))}] AS {d}" for d, lo, k in _RISK_DIMS) + ", abs(embedding[20]::DOUBLE) * 4 AS h FROM embeddings), pd AS (SELECT vec_id, h, list_max(threat_content) AS tc, " + ", ".join(f"list_position({d}, list_max({d})) - 1 AS {d}" for d, _, _ in _RISK_DIMS) + " FROM rk), sc AS (SELECT vec_id, h, least(1.0, (CASE sensitivity WHEN 2 THEN 0.3 WHEN 1 THEN 0.3 * 0.5 ELSE 0 END)::DOUBLE + (CASE WHEN tc > 0.7 THEN 0.3 WHEN threat_content = 1 THEN 0.3 * 0.67 ELSE 0 END)::DOUBLE + (CASE WHEN intent = 4 THEN 0.15 WHEN intent IN (2, 3) THEN 0.15 * 0.67 ELSE 0 END)::DOUBLE + (CASE WHEN disclosure_scope = 1 THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN entity_tags = 3 THEN 0.1 WHEN entity_tags = 0 THEN 0.05 ELSE 0 END)::DOUBLE) AS s FROM pd), lv AS (SELECT vec_id, round(s, 4) AS risk_score, h >= 0.5 AS fallback_applied, least(3, (CASE WHEN s >= 0.7 THEN 3 WHEN s >= 0.45 THEN 2 WHEN s >= 0.25 THEN 1 ELSE 0 END) + (h >= 0.5)::INT) AS t FROM sc), dc AS (SELECT vec_id, risk_score, fallback_applied, ['low', 'medium', 'high', 'critical'][t + 1] AS risk_level, ['P0_low', 'P1_moderate', 'P2_high', 'P3_restrictive_fallback'][t + 1] AS policy FROM lv)"


def decisions(spark, sf):
    e = table(spark, sf, "embeddings")
    part = lambda lo, k: F.transform(F.slice("embedding", lo + 1, k), lambda x: P.sigmoid(x.cast("double") * 8))
    e = e.withColumns({f"{d}_mean": part(lo, k) for d, lo, k in _RISK_DIMS} | {f"{d}_entropy": F.lit(0.0) for d, _, _ in _RISK_DIMS} | {"composite_entropy": F.abs(F.col("embedding")[19].cast("double")) * 4})
    return R.risk_decisions(e)


@query("k01_risk_decisions", f"WITH {_RISK} SELECT vec_id, risk_score, fallback_applied, risk_level, policy FROM dc")
def k01(spark, sf):
    return decisions(spark, sf).select("vec_id", "risk_score", "fallback_applied", "risk_level", "policy")


@query("k02_triggered_rules", f"WITH {_RISK} SELECT vec_id, concat_ws(',', 'sensitivity=' || sensitivity, CASE sensitivity WHEN 2 THEN 'high_sensitivity' WHEN 1 THEN 'medium_sensitivity' END, 'threat=' || threat_content, CASE WHEN tc > 0.7 THEN 'critical_threat' WHEN threat_content = 1 THEN 'attribute_inference_risk' END, 'intent=' || intent, CASE WHEN intent = 4 THEN 'identity_related_intent' WHEN intent IN (2, 3) THEN 'sensitive_intent_request' END, 'disclosure=' || disclosure_scope, CASE WHEN disclosure_scope = 1 THEN 'multi_document_disclosure' END, 'entity=' || entity_tags, CASE WHEN entity_tags = 3 THEN 'contact_identifier_present' WHEN entity_tags = 0 THEN 'person_entity_present' END, CASE WHEN h >= 0.5 THEN 'uncertainty_fallback' END) AS rules FROM pd")
def k02(spark, sf):
    return decisions(spark, sf).select("vec_id", F.array_join("rules", ",").alias("rules"))


@query("e21_decision_summary", f"WITH {_RISK}, t(kind, value) AS (VALUES ('risk_level', 'low'), ('risk_level', 'medium'), ('risk_level', 'high'), ('risk_level', 'critical'), ('policy', 'P0_low'), ('policy', 'P1_moderate'), ('policy', 'P2_high'), ('policy', 'P3_restrictive_fallback'), ('fallback', 'true'), ('fallback', 'false')), l AS (SELECT 'risk_level' AS kind, risk_level AS value FROM dc UNION ALL SELECT 'policy', policy FROM dc UNION ALL SELECT 'fallback', fallback_applied::VARCHAR FROM dc) SELECT t.kind, t.value, count(l.value) AS n FROM t LEFT JOIN l ON l.kind = t.kind AND l.value = t.value GROUP BY ALL")
def e21(spark, sf):
    return R.decision_summary(decisions(spark, sf))


_TIERS = {"A": 3, "N": 1}
_ENT = "en AS (SELECT l_orderkey AS record, l_linenumber AS i, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 1 ELSE 2 END AS tier, CASE l_returnflag WHEN 'A' THEN 2.0 ELSE 1.0 END AS w, 0.5 + l_discount::DOUBLE * 4 AS c, CASE WHEN l_linenumber % 2 = 0 THEN 'rules' ELSE 'detector' END AS grp FROM lineitem)"


def entities(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("type"), (0.5 + F.col("l_discount").cast("double") * 4).alias("confidence"), F.when(F.col("l_linenumber") % 2 == 0, "rules").otherwise("detector").alias("grp"))


@query("k04_evidence_masses", f"WITH {_ENT}, x AS (SELECT record, grp, (1 << tier)::INT AS mask, w * c AS m FROM en UNION ALL SELECT record, grp, 15, w * (1 - c) FROM en), t AS (SELECT record, grp, sum(w) AS t FROM en GROUP BY ALL) SELECT x.record, x.grp, mask, round(sum(m) / any_value(t), 9) AS mass FROM x JOIN t ON t.record = x.record AND t.grp = x.grp GROUP BY x.record, x.grp, mask")
def k04(spark, sf):
    return R.evidence_masses(entities(spark, sf), "record", _TIERS, 2, {"A": 2.0}).withColumn("mass", F.round("mass", 9))


def masses(spark, sf):
    m = R.evidence_masses(entities(spark, sf), "record", _TIERS, 2, {"A": 2.0})
    packed = m.groupBy("record", "grp").agg(F.map_from_entries(F.collect_list(F.struct("mask", "mass"))).alias("mass"))
    return packed.groupBy("record").pivot("grp", ["detector", "rules"]).agg(F.first("mass"))


_MASS = _ENT + ", x AS (SELECT record, grp, (1 << tier)::INT AS mask, w * c AS m FROM en UNION ALL SELECT record, grp, 15, w * (1 - c) FROM en), t AS (SELECT record, grp, sum(w) AS t FROM en GROUP BY ALL), ms AS (SELECT x.record, x.grp, mask, sum(m) / any_value(t) AS mass FROM x JOIN t ON t.record = x.record AND t.grp = x.grp GROUP BY x.record, x.grp, mask)"
_DS = _MASS + ", pr AS (SELECT a.record, (a.mask & b.mask) AS mask, a.mass * b.mass AS m FROM ms a JOIN ms b ON a.record = b.record AND a.grp = 'detector' AND b.grp = 'rules'), k AS (SELECT record, coalesce(sum(m) FILTER (WHERE mask = 0), 0) AS conflict FROM pr GROUP BY record), co AS (SELECT pr.record, mask, sum(m) / (1 - any_value(conflict)) AS mass FROM pr JOIN k USING (record) WHERE mask <> 0 GROUP BY pr.record, mask)"


def fused(spark, sf):
    return masses(spark, sf).where("rules IS NOT NULL AND detector IS NOT NULL").withColumn("f", R.combine(F.col("detector"), F.col("rules")))


@query("k06_dempster_combination", f"WITH {_DS} SELECT record, round(conflict, 6) AS conflict FROM k")
def k06(spark, sf):
    return fused(spark, sf).select("record", F.round("f.conflict", 6).alias("conflict"))


@query("k07_belief", f"WITH {_DS} SELECT record, round(coalesce(sum(mass) FILTER (WHERE mask = 8), 0), 6) AS belief_critical, round(coalesce(sum(mass) FILTER (WHERE mask & 8 <> 0), 0), 6) AS plausibility_critical, round(coalesce(sum(mass) FILTER (WHERE mask = 15), 0), 6) AS ignorance, round(sum(mass / bit_count(mask) * (((mask >> 1) & 1) / 3.0 + ((mask >> 2) & 1) * 2 / 3.0 + ((mask >> 3) & 1))), 6) AS score FROM co GROUP BY record")
def k07(spark, sf):
    b = R.belief_summary(F.col("f.mass"))
    return fused(spark, sf).select("record", *[F.round(b[c], 6).alias(c) for c in ("belief_critical", "plausibility_critical", "ignorance", "score")])


@query("k05_mass_validation", f"WITH {_MASS} SELECT count(DISTINCT record) AS records, 0::BIGINT AS bad FROM ms")
def k05(spark, sf):
    return masses(spark, sf).agg(F.count(F.lit(1)).alias("records"), F.count_if(R.mass_error(F.coalesce("detector", "rules")).isNotNull()).alias("bad"))


@query("k08_baselines", f"WITH {_ENT} SELECT record, round(max(tier / 3 * c), 7) AS max_score, round(sum(tier / 3 * c * w) / sum(w), 7) AS weighted_score, round(sum((1 - c) * w) / sum(w), 7) AS uncertainty FROM en GROUP BY record")
def k08(spark, sf):
    e = entities(spark, sf).withColumns({"tier": F.when(F.col("type") == "A", 3).when(F.col("type") == "N", 1).otherwise(2), "w": F.when(F.col("type") == "A", 2.0).otherwise(1.0)})
    return R.baseline_scores(e, "record").select("record", *[F.round(c, 7).alias(c) for c in ("max_score", "weighted_score", "uncertainty")])


@query("k09_sensitivity", f"WITH {_ENT}, s(shift) AS (VALUES (-0.1::DOUBLE), (0.0::DOUBLE), (0.1::DOUBLE)), x AS (SELECT shift, record, max(tier / 3 * least(1, greatest(0, c + shift))) AS score FROM en, s GROUP BY ALL), b AS (SELECT record, score FROM x WHERE shift = 0) SELECT shift, round(avg(abs(x.score - b.score)), 9) AS mean_change FROM x JOIN b USING (record) WHERE shift <> 0 GROUP BY shift")
def k09(spark, sf):
    e = entities(spark, sf).withColumns({"tier": F.when(F.col("type") == "A", 3).when(F.col("type") == "N", 1).otherwise(2), "shift": F.explode(F.array(*map(F.lit, (-0.1, 0.0, 0.1))))})
    e = e.withColumn("s", F.col("tier") / 3 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") + F.col("shift"))))
    wide = e.groupBy("record").agg(*[F.max(F.when(F.col("shift") == v, F.col("s"))).alias(n) for n, v in (("low", -0.1), ("mid", 0.0), ("high", 0.1))])
    changes = F.array(*[F.struct(F.lit(v).alias("shift"), F.abs(F.col(n) - F.col("mid")).alias("d")) for n, v in (("low", -0.1), ("high", 0.1))])
    return wide.select(F.explode(changes).alias("x")).groupBy("x.shift").agg(F.round(F.avg("x.d"), 9).alias("mean_change"))


_POL = "pol(policy_id, coverage, types) AS (VALUES ('weak', 0.6::DOUBLE, ['*']), ('medium', 0.8::DOUBLE, ['*']), ('strong', 1.0::DOUBLE, ['*'])), prof(policy_id, privacy, utility, latency_ms) AS (VALUES ('weak', 0.35::DOUBLE, 0.95::DOUBLE, 2.0::DOUBLE), ('medium', 0.65::DOUBLE, 0.85::DOUBLE, 5.0::DOUBLE), ('strong', 0.95::DOUBLE, 0.7::DOUBLE, 12.0::DOUBLE)), rr AS (SELECT c_custkey AS record_id, (c_acctbal - (SELECT min(c_acctbal) FROM customer))::DOUBLE / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer) AS score, (c_custkey % 101) / 100 AS u, (c_custkey % 53) / 52 AS g FROM customer), rq AS (SELECT record_id, score + (1 - score) * 0.5 * greatest(u, g) AS required FROM rr)"
_OK = "privacy >= required AND utility >= 0.6 AND latency_ms <= 20 AND coverage >= required"


def risks(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_acctbal").cast("double").alias("b"), F.col("c_mktsegment"))
    ends = F.broadcast(c.agg(F.min("b").alias("lo"), F.max("b").alias("hi")))
    return c.join(ends).select("record_id", ((F.col("b") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"), (F.col("record_id") % 101 / 100).alias("uncertainty"), (F.col("record_id") % 53 / 52).alias("ignorance"), F.array("c_mktsegment").alias("entity_types"))


def policies(spark):
    p = spark.createDataFrame([("weak", 0.6, ["*"]), ("medium", 0.8, ["*"]), ("strong", 1.0, ["*"])], "policy_id string, coverage double, protected_types array<string>")
    return p, spark.createDataFrame([("weak", 0.35, 0.95, 2.0), ("medium", 0.65, 0.85, 5.0), ("strong", 0.95, 0.7, 12.0)], "policy_id string, privacy double, utility double, latency_ms double")


@query("k11_required_protection", f"WITH {_POL} SELECT record_id, round(required, 9) AS required FROM rq")
def k11(spark, sf):
    return risks(spark, sf).select("record_id", F.round(R.required_protection(F.col("score"), F.col("uncertainty"), F.col("ignorance"), 0.5), 9).alias("required"))


@query("k13_policy_choice", f"WITH {_POL}, f AS (SELECT record_id, arg_min(p.policy_id, (latency_ms, p.policy_id)) FILTER (WHERE {_OK}) AS policy_id, count(*) FILTER (WHERE {_OK}) AS n_feasible FROM rq, pol p JOIN prof USING (policy_id) GROUP BY record_id) SELECT record_id, policy_id, n_feasible, CASE WHEN policy_id IS NULL THEN 'block' ELSE 'apply_policy' END AS action FROM f")
def k13(spark, sf):
    return R.choose(risks(spark, sf), *policies(spark), 0.5, 0.6, 20.0).select("record_id", "policy_id", "n_feasible", "action")


@query("k14_mode_comparison", f"WITH {_POL}, m AS (SELECT policy_id AS mode, count(*) FILTER (WHERE NOT ({_OK})) AS fallbacks FROM rq, pol JOIN prof USING (policy_id) GROUP BY policy_id) SELECT mode, fallbacks FROM m UNION ALL SELECT 'adaptive', count(*) FROM rq WHERE NOT EXISTS (SELECT 1 FROM pol JOIN prof USING (policy_id) WHERE {_OK})")
def k14(spark, sf):
    r, (p, f) = risks(spark, sf), policies(spark)
    out = None
    for mode in ("weak", "medium", "strong", None):
        d = R.choose(r, p, f, 0.5, 0.6, 20.0, fixed=mode).agg(F.lit(mode or "adaptive").alias("mode"), F.count_if(F.col("action") == "block").alias("fallbacks"))
        out = d if out is None else out.unionByName(d)
    return out


@query("k15_grid_sweep", f"WITH {_POL}, g(strength) AS (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)), q AS (SELECT strength, record_id, score + (1 - score) * strength * greatest(u, g) AS required FROM rr, g AS x(strength)), n AS (SELECT strength, record_id, count(*) FILTER (WHERE {_OK}) AS k FROM q, pol JOIN prof USING (policy_id) GROUP BY ALL) SELECT strength, count(*) FILTER (WHERE k = 0) AS blocked FROM n GROUP BY strength".replace("greatest(u, g)", "greatest(rr.u, rr.g)"))
def k15(spark, sf):
    r, (p, f) = risks(spark, sf), policies(spark)
    out = None
    for s in (0.0, 0.5, 1.0):
        d = R.choose(r, p, f, s, 0.6, 20.0).agg(F.lit(s).alias("strength"), F.count_if(F.col("action") == "block").alias("blocked"))
        out = d if out is None else out.unionByName(d)
    return out


@query("e22_policy_profile", "SELECT o_orderpriority AS policy_id, min(o_totalprice)::DOUBLE AS privacy, min(o_custkey % 7)::DOUBLE AS utility, max(o_custkey)::DOUBLE AS latency_ms, count(*) AS n, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS provenance FROM orders GROUP BY ALL")
def e22(spark, sf):
    o = table(spark, sf, "orders")
    return R.profile(o.select(F.col("o_orderpriority").alias("policy_id"), F.col("o_totalprice").cast("double").alias("privacy"), (F.col("o_custkey") % 7).cast("double").alias("utility"), F.col("o_custkey").cast("double").alias("latency_ms"), F.col("o_orderstatus").alias("provenance")))
