"""Queries on how risk scores answer to changed evidence, by method, and what policies follow from each."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.operators import risk as R
from veilmark.plans.registry import query
from veilmark.plans.scores import _ENT, entities, policies

_GROUPS = ("detector", "rules")


def tiered(spark, sf):
    kind = F.col("type")
    return entities(spark, sf).withColumns({"tier": F.when(kind == "A", 3).when(kind == "N", 1).otherwise(2), "w": F.when(kind == "A", 2.0).otherwise(1.0)})


#: Views up to ``sc``: (record, scenario, method, score, uncertainty, ignorance).
_SCORES = _ENT + """, sn(scenario, shift, times) AS (VALUES ('base', 0.0::DOUBLE, 1), ('less', -0.1::DOUBLE, 1), ('more', 0.1::DOUBLE, 1), ('twice', 0.0::DOUBLE, 2)),
ex AS (SELECT record, grp, tier, scenario, w * times AS w, least(1, greatest(0, c + shift)) AS c FROM en, sn),
sm AS (SELECT record, scenario, grp, sum(w) AS t FROM ex GROUP BY ALL),
mm AS (SELECT record, scenario, grp, (1 << tier)::INT AS mask, w * c AS m FROM ex UNION ALL SELECT record, scenario, grp, 15, w * (1 - c) FROM ex),
ma AS (SELECT mm.record, mm.scenario, mm.grp, mask, sum(m) / any_value(t) AS mass FROM mm JOIN sm USING (record, scenario, grp) GROUP BY mm.record, mm.scenario, mm.grp, mask),
pp AS (SELECT a.record, a.scenario, a.mask & b.mask AS mask, a.mass * b.mass AS m FROM ma a JOIN ma b ON a.record = b.record AND a.scenario = b.scenario AND a.grp = 'detector' AND b.grp = 'rules'),
kk AS (SELECT record, scenario, coalesce(sum(m) FILTER (WHERE mask = 0), 0) AS conflict FROM pp GROUP BY ALL),
cc AS (SELECT pp.record, pp.scenario, mask, sum(m) / (1 - any_value(conflict)) AS mass FROM pp JOIN kk USING (record, scenario) WHERE mask <> 0 AND conflict < 1 - 1e-8 GROUP BY pp.record, pp.scenario, mask
  UNION ALL SELECT record, scenario, 15, 1.0 FROM kk WHERE conflict >= 1 - 1e-8
  UNION ALL SELECT record, scenario, mask, mass FROM ma WHERE NOT EXISTS (SELECT 1 FROM kk WHERE kk.record = ma.record AND kk.scenario = ma.scenario)),
ds AS (SELECT record, scenario, sum(mass / bit_count(mask) * (((mask >> 1) & 1) / 3.0 + ((mask >> 2) & 1) * 2 / 3.0 + ((mask >> 3) & 1))) AS score, coalesce(sum(mass) FILTER (WHERE mask = 15), 0) AS ignorance FROM cc GROUP BY ALL),
bs AS (SELECT record, scenario, max(tier / 3 * c) AS a, sum(tier / 3 * c * w) / sum(w) AS b, sum((1 - c) * w) / sum(w) AS u FROM ex GROUP BY ALL),
sc AS (SELECT record, scenario, 'max' AS method, a AS score, u AS uncertainty, u AS ignorance FROM bs UNION ALL SELECT record, scenario, 'weighted', b, u, u FROM bs UNION ALL SELECT record, scenario, 'ds', score, u, ignorance FROM ds JOIN bs USING (record, scenario))"""


@query("k09_method_scores", f"WITH {_SCORES} SELECT record, scenario, method, round(score + 1e-10, 7) AS score, round(uncertainty + 1e-10, 7) AS uncertainty, round(ignorance + 1e-10, 7) AS ignorance FROM sc")
def k09_scores(spark, sf):
    s = R.method_scores(tiered(spark, sf), "record", _GROUPS, R.SCENARIOS)
    return s.select("record", "scenario", "method", *[F.round(F.col(c) + 1e-10, 7).alias(c) for c in ("score", "uncertainty", "ignorance")])  # scores lie on borders of rounding


@query("k09_by_method", f"WITH {_SCORES}, b AS (SELECT record, method, score FROM sc WHERE scenario = 'base') SELECT method, scenario, count(*) AS records, round(avg(abs(sc.score - b.score)), 7) AS mean_change, round(max(abs(sc.score - b.score)), 7) AS max_change FROM sc JOIN b USING (record, method) WHERE scenario <> 'base' GROUP BY method, scenario")
def k09_methods(spark, sf):
    s = R.sensitivity(R.method_scores(tiered(spark, sf), "record", _GROUPS, R.SCENARIOS), "record", scenarios=list(R.SCENARIOS))
    return s.withColumns({c: F.round(c, 7) for c in ("mean_change", "max_change")})


@query("k09_conflict_grid", "WITH c AS (SELECT 0.5 + l_discount::DOUBLE * 5 AS c, count(*) AS n FROM lineitem GROUP BY l_discount) SELECT round(c, 6) AS confidence, n, round(least(c, 1) * least(c, 1), 7) AS conflict, c * c >= 1 - 1e-8 AS failed, round(CASE WHEN c * c >= 1 - 1e-8 THEN 1 ELSE (1 - c) * (1 - c) / (1 - c * c) END, 7) AS ignorance FROM c")
def k09_conflicts(spark, sf):
    """Every confidence that occurs, as evidence of the lowest tier against as much of the highest."""
    from veilmark.plans.fixtures import table

    c = table(spark, sf, "lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n")).select((0.5 + F.col("l_discount").cast("double") * 5).alias("c"), "n")
    side = lambda mask: F.map_from_arrays(F.array(F.lit(mask), F.lit(R.FRAME)), F.array(F.least("c", F.lit(1.0)), 1 - F.least("c", F.lit(1.0))))
    f = c.withColumn("f", R.combine(side(1), side(8)))
    return f.select(F.round("c", 6).alias("confidence"), "n", F.round("f.conflict", 7).alias("conflict"), F.col("f.failed").alias("failed"), F.round(R.belief_summary(F.col("f.mass"))["ignorance"], 7).alias("ignorance"))


#: Policies for scores that are nearly sure: what is required stays away from their borders.
@query("k16_policies_by_method", f"""WITH {_SCORES}, q AS (SELECT record, method, round(score + (1 - score) * 0.5 * greatest(uncertainty, ignorance), 6) AS required FROM sc WHERE scenario = 'base'),
o(policy_id, coverage, privacy, utility, latency_ms) AS (VALUES ('weak', 0.6::DOUBLE, 0.35::DOUBLE, 0.95::DOUBLE, 2.0::DOUBLE), ('medium', 0.8::DOUBLE, 0.65::DOUBLE, 0.85::DOUBLE, 5.0::DOUBLE), ('strong', 1.0::DOUBLE, 0.95::DOUBLE, 0.7::DOUBLE, 12.0::DOUBLE)),
c AS (SELECT record, method, arg_min(policy_id, (latency_ms, policy_id)) FILTER (WHERE privacy >= required AND coverage >= required AND utility >= 0.6 AND latency_ms <= 20) AS policy_id FROM q, o GROUP BY record, method)
SELECT method, coalesce(policy_id, 'block') AS policy, count(*) AS n FROM c GROUP BY ALL""")
def k16_policies(spark, sf):
    s = R.method_scores(tiered(spark, sf), "record", _GROUPS)
    required = F.round(R.required_protection(F.col("score"), F.col("uncertainty"), F.col("ignorance"), 0.5), 6)
    risks = s.select(F.struct("record", "method").alias("record_id"), required.alias("score"), F.lit(0.0).alias("uncertainty"), F.lit(0.0).alias("ignorance"), F.array(F.lit("x")).alias("entity_types"))
    chosen = R.choose(risks, *policies(spark), 0.5, 0.6, 20.0)
    return chosen.groupBy(F.col("record_id.method").alias("method"), F.coalesce("policy_id", F.lit("block")).alias("policy")).agg(F.count(F.lit(1)).alias("n"))
