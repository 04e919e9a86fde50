"""Risk scores, belief masses and policy choice."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.probs import argmax

# Weights, thresholds, levels and policies of the additive score.
WEIGHTS = {"sensitivity": 0.30, "threat_content": 0.30, "intent": 0.15, "disclosure_scope": 0.10, "entity_tags": 0.10}
THRESHOLDS = {"critical": 0.70, "high": 0.45, "medium": 0.25}
LEVELS = ["low", "medium", "high", "critical"]
POLICIES = {"low": "P0_low", "medium": "P1_moderate", "high": "P2_high", "critical": "P3_restrictive_fallback"}
TIERS = ["Low", "Medium", "High", "Critical"]
FRAME = 15


def risk_decisions(df: DataFrame, uncertainty_threshold: float = 0.5, critical_threats: tuple[int, ...] = (), weights: dict | None = None, fallback: bool = True) -> DataFrame:
    """``df`` with risk_score, rules, risk_level, policy and fallback_applied, from <dim>_mean arrays and <dim>_entropy.

    ``critical_threats`` are indices; names never match an index, which is why there are none by default."""
    w = WEIGHTS | (weights or {})
    best = {d: argmax(F.col(f"{d}_mean")) for d in WEIGHTS}
    df = df.withColumns({f"{d}_pred": v for d, v in best.items()})
    p = {d: F.col(f"{d}_pred") for d in WEIGHTS}
    critical = (F.array_max("threat_content_mean") > 0.7) | (p["threat_content"].isin(*critical_threats) if critical_threats else F.lit(False))
    parts = [
        F.when(p["sensitivity"] == 2, w["sensitivity"]).when(p["sensitivity"] == 1, w["sensitivity"] * 0.5).otherwise(0.0),
        F.when(critical, w["threat_content"]).when(p["threat_content"] == 1, w["threat_content"] * 0.67).otherwise(0.0),
        F.when(p["intent"] == 4, w["intent"]).when(p["intent"].isin(2, 3), w["intent"] * 0.67).otherwise(0.0),
        F.when(p["disclosure_scope"] == 1, w["disclosure_scope"]).otherwise(0.0),
        F.when(p["entity_tags"] == 3, w["entity_tags"]).when(p["entity_tags"] == 0, w["entity_tags"] * 0.5).otherwise(0.0),
    ]
    score = parts[0]
    for x in parts[1:]:
        score = score + x
    score = F.least(score, F.lit(1.0))
    given = F.coalesce(F.col("composite_entropy"), F.lit(0.0)) if "composite_entropy" in df.columns else F.lit(0.0)
    mean = F.lit(0.0)
    for d in WEIGHTS:
        mean = mean + F.coalesce(F.col(f"{d}_entropy"), F.lit(0.0))
    composite = F.when(given == 0, mean / len(WEIGHTS)).otherwise(given)
    raised = (composite >= uncertainty_threshold) & F.lit(fallback)
    tier = F.when(score >= THRESHOLDS["critical"], 3).when(score >= THRESHOLDS["high"], 2).when(score >= THRESHOLDS["medium"], 1).otherwise(0)
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.least(tier + raised.cast("int"), F.lit(3)) + 1)
    name = lambda label, d: F.concat(F.lit(label + "="), p[d].cast("string"))
    rules = F.array_compact(
        F.array(
            name("sensitivity", "sensitivity"),
            F.when(p["sensitivity"] == 2, "high_sensitivity").when(p["sensitivity"] == 1, "medium_sensitivity"),
            name("threat", "threat_content"),
            F.when(critical, "critical_threat").when(p["threat_content"] == 1, "attribute_inference_risk"),
            name("intent", "intent"),
            F.when(p["intent"] == 4, "identity_related_intent").when(p["intent"].isin(2, 3), "sensitive_intent_request"),
            name("disclosure", "disclosure_scope"),
            F.when(p["disclosure_scope"] == 1, "multi_document_disclosure"),
            name("entity", "entity_tags"),
            F.when(p["entity_tags"] == 3, "contact_identifier_present").when(p["entity_tags"] == 0, "person_entity_present"),
            F.when(raised, "uncertainty_fallback"),
        )
    )
    policy = F.element_at(F.create_map(*[F.lit(x) for kv in POLICIES.items() for x in kv]), F.col("risk_level"))
    return df.withColumns({"risk_score": F.round(score, 4), "composite": F.round(composite, 4), "rules": rules, "risk_level": level, "fallback_applied": raised}).withColumn("policy", policy)


def decision_summary(df: DataFrame) -> DataFrame:
    """(kind, value, n) for each level, policy and fallback; values without rows count 0."""
    rows = [("risk_level", v) for v in LEVELS] + [("policy", v) for v in POLICIES.values()] + [("fallback", v) for v in ("true", "false")]
    every = df.sparkSession.createDataFrame(rows, "kind string, value string")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in (("risk_level", F.col("risk_level")), ("policy", F.col("policy")), ("fallback", F.col("fallback_applied").cast("string")))])).alias("x")).select("x.*")
    #: a row for each level, policy and answer
    return every.join(F.broadcast(long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))), ["kind", "value"], "left").fillna(0, ["n"])


def evidence_masses(entities: DataFrame, record: str, tiers: dict[str, int], unknown: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(record, grp, mask, mass) of rows (record, type, confidence, grp): each entity's mass on its tier and the frame, pooled by weight."""
    if any(x <= 0 for x in (weights or {}).values()):
        raise ValueError("weights must be positive")
    lookup = lambda table, default: F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in table.items()], F.lit(default))
    e = entities.withColumns({"tier": lookup(tiers, unknown), "w": lookup(weights or {}, 1.0).cast("double")})
    # a weight counts with its own part only, so that one aggregate has both the masses and their total
    halves = F.explode(F.array(F.struct((F.pow(F.lit(2), F.col("tier"))).cast("int").alias("mask"), F.col("confidence").alias("m"), F.col("w").alias("t")), F.struct(F.lit(FRAME).alias("mask"), (1 - F.col("confidence")).alias("m"), F.lit(0.0).alias("t"))))
    sums = e.select(record, "grp", "w", halves.alias("x")).groupBy(record, "grp", F.col("x.mask").alias("mask")).agg(F.sum(F.col("w") * F.col("x.m")).alias("s"), F.sum("x.t").alias("t"))
    packed = sums.groupBy(record, "grp").agg(F.collect_list(F.struct("mask", "s")).alias("m"), F.sum("t").alias("t"))
    return packed.select(record, "grp", "t", F.explode("m").alias("m")).select(record, "grp", "m.mask", (F.col("m.s") / F.col("t")).alias("mass"))


def mass_error(mass: Column) -> Column:
    """What is wrong with a map<int,double> of masses, or null."""
    keys, values = F.map_keys(mass), F.map_values(mass)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(mass) == 0, "empty").when(F.exists(keys, lambda k: (k < 1) | (k > FRAME)), "mask").when(F.exists(values, lambda v: (v < 0) | F.isnan(v)), "negative").when(F.abs(total - 1) > 1e-8, "sum")


def combine(a: Column, b: Column, limit: float = 1 - 1e-8) -> Column:
    """struct<mass, conflict, failed> of Dempster's rule; at a conflict of ``limit`` the mass is total ignorance."""
    pairs = F.flatten(F.transform(F.map_entries(a), lambda x: F.transform(F.map_entries(b), lambda y: F.struct(x["key"].bitwiseAND(y["key"]).alias("mask"), (x["value"] * y["value"]).alias("m")))))
    conflict = F.aggregate(F.filter(pairs, lambda p: p["mask"] == 0), F.lit(0.0), lambda s, p: s + p["m"])
    kept = F.array_distinct(F.transform(F.filter(pairs, lambda p: p["mask"] != 0), lambda p: p["mask"]))
    mass = F.map_from_entries(F.transform(kept, lambda k: F.struct(k, (F.aggregate(F.filter(pairs, lambda p: p["mask"] == k), F.lit(0.0), lambda s, p: s + p["m"]) / (1 - conflict)))))
    return F.struct(F.when(conflict >= limit, F.create_map(F.lit(FRAME), F.lit(1.0))).otherwise(mass).alias("mass"), conflict.alias("conflict"), (conflict >= limit).alias("failed"))


def belief_summary(mass: Column) -> dict[str, Column]:
    """belief, plausibility and pignistic probability of each tier, ignorance, score and tier, of a map of masses."""
    e = F.map_entries(mass)
    over = lambda cond, value: F.aggregate(F.filter(e, cond), F.lit(0.0), lambda s, x: s + value(x))
    out: dict[str, Column] = {}
    probs = []
    for i, t in enumerate(TIERS):
        bit = 1 << i
        out[f"belief_{t.lower()}"] = over(lambda x: x["key"] == bit, lambda x: x["value"])
        out[f"plausibility_{t.lower()}"] = over(lambda x: x["key"].bitwiseAND(bit) != 0, lambda x: x["value"])
        probs.append(over(lambda x: x["key"].bitwiseAND(bit) != 0, lambda x: x["value"] / F.bit_count(x["key"])))
    score = probs[1] / 3 + probs[2] * 2 / 3 + probs[3]
    out |= {f"p_{t.lower()}": p for t, p in zip(TIERS, probs)}
    return out | {"ignorance": F.coalesce(F.try_element_at(mass, F.lit(FRAME)), F.lit(0.0)), "score": score, "tier": F.element_at(F.array(*map(F.lit, TIERS)), argmax(F.array(*probs)) + 1)}


def baseline_scores(entities: DataFrame, record: str) -> DataFrame:
    """(record, max_score, weighted_score, uncertainty, tiers) of rows (record, tier, confidence, w)."""
    s = F.col("tier") / 3 * F.col("confidence")
    g = entities.groupBy(record).agg(F.max(s).alias("max_score"), (F.sum(s * F.col("w")) / F.sum("w")).alias("weighted_score"), (F.sum((1 - F.col("confidence")) * F.col("w")) / F.sum("w")).alias("uncertainty"))
    tier = lambda c: F.element_at(F.array(*map(F.lit, TIERS)), F.least(F.floor(c * 3 + 0.5).cast("int"), F.lit(3)) + 1)
    return g.withColumns({"max_tier": tier(F.col("max_score")), "weighted_tier": tier(F.col("weighted_score"))})


#: What may happen to evidence: its confidence moved, within 0 and 1, or every entity given twice.
SCENARIOS = {"base": (0.0, 1), "less": (-0.1, 1), "more": (0.1, 1), "twice": (0.0, 2)}


def _combined(a: list[Column], b: list[Column]) -> tuple[list[Column], Column]:
    """Dempster's rule for masses on single tiers and, last, on the frame: the unscaled products by tier and frame, and the conflict."""
    n = len(TIERS)
    kept = [a[t] * b[t] + a[t] * b[n] + a[n] * b[t] for t in range(n)] + [a[n] * b[n]]
    conflict = reduce(add, [a[t] * b[u] for t in range(n) for u in range(n) if t != u])
    return kept, conflict


def method_scores(entities: DataFrame, record: str, groups: tuple[str, ...], scenarios: dict[str, tuple[float, int]] | None = None, limit: float = 1 - 1e-8) -> DataFrame:
    """(record, scenario, method, score, uncertainty, ignorance, conflict) by ``max``, ``weighted`` and ``ds`` of rows (record, tier, confidence, w, grp).

    ``max`` and ``weighted`` take the tiers' discounted scores; ``ds`` pools each group's masses and combines ``groups`` in order,
    total ignorance where two conflict by ``limit``. Each scenario moves all confidences and repeats all entities. One shuffle
    of a row a record: sums of weights by shift, group and tier, whatever the number of entities; repeats multiply these. A
    record's rows are made from it in place, and masses are plain columns: pooled ones lie on single tiers and the frame only,
    and so do their combinations."""
    chosen = scenarios or {"base": (0.0, 1)}
    tiers, shifts = range(len(TIERS)), list(dict.fromkeys(shift for shift, _ in chosen.values()))
    w = F.col("w").cast("double")
    sums = [F.sum(w).alias("_w"), *[F.sum(F.when(F.col("grp") == g, w)).alias(f"_t{i}") for i, g in enumerate(groups)]]
    for k, shift in enumerate(shifts):
        c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") + F.lit(shift)))
        s = F.col("tier") / 3 * c
        sums += [F.max(s).alias(f"_max{k}"), F.sum(s * w).alias(f"_sw{k}"), F.sum((1 - c) * w).alias(f"_uw{k}")]
        sums += [F.sum(F.when((F.col("grp") == g) & (F.col("tier") == t), w * c)).alias(f"_m{k}_{i}_{t}") for i, g in enumerate(groups) for t in tiers]
    wide = entities.groupBy(record).agg(*sums)
    each = []
    for n, (shift, times) in chosen.items():
        k = shifts.index(shift)
        sources = {"_w": "_w", "_sw": f"_sw{k}", "_uw": f"_uw{k}"} | {f"_t{i}": f"_t{i}" for i, _ in enumerate(groups)} | {f"_m{i}_{t}": f"_m{k}_{i}_{t}" for i, _ in enumerate(groups) for t in tiers}
        each.append(F.struct(F.lit(n).alias("scenario"), F.col(f"_max{k}").alias("_max"), *[(F.col(c) * F.lit(times)).alias(out) for out, c in sources.items()]))
    rows = wide.select(record, F.explode(F.array(*each)).alias("_x")).select(record, "_x.*")
    n = len(TIERS)
    names = [f"_f{t}" for t in range(n + 1)]
    # the masses so far, none yet, and how the last two groups went together
    rows = rows.withColumns({f: F.lit(None).cast("double") for f in names} | {"_conflict": F.lit(0.0), "_failed": F.lit(False)})
    for i, _ in enumerate(groups):
        here = F.col(f"_t{i}").isNotNull()
        parts = {f"_o{t}": F.coalesce(F.col(f"_m{i}_{t}") / F.col(f"_t{i}"), F.lit(0.0)) for t in tiers}
        rows = rows.withColumns(parts)
        rows = rows.withColumn(f"_o{n}", F.greatest(F.lit(0.0), 1 - reduce(add, [F.col(f"_o{t}") for t in tiers])))
        own = [F.col(f"_o{t}") for t in range(n + 1)]
        first, both = F.col("_f0").isNull(), F.col("_f0").isNotNull() & here & ~F.col("_failed")
        kept, conflict = _combined([F.col(f) for f in names], own)
        rows = rows.withColumns({"_both": both, "_clash": conflict} | {f"_k{t}": x for t, x in enumerate(kept)})
        fails = F.col("_both") & (F.col("_clash") >= limit)
        ignorant = [F.lit(0.0)] * n + [F.lit(1.0)]
        rows = rows.withColumns(
            {f: F.when(first, F.when(here, own[t])).when(fails, ignorant[t]).when(F.col("_both"), F.col(f"_k{t}") / (1 - F.col("_clash"))).otherwise(F.col(f)) for t, f in enumerate(names)}
            | {"_conflict": F.when(F.col("_both"), F.col("_clash")).otherwise(F.col("_conflict")), "_failed": F.when(F.col("_both"), fails).otherwise(F.col("_failed"))}
        )
    f = [F.col(x) for x in names]
    pignistic = [f[t] + f[n] / n for t in tiers]
    score = pignistic[1] / 3 + pignistic[2] * 2 / 3 + pignistic[3]
    unc = F.col("_uw") / F.col("_w")
    out = lambda m, score, ignorance, conflict: F.struct(F.lit(m).alias("method"), score.alias("score"), ignorance.alias("ignorance"), conflict.alias("conflict"))
    methods = F.array(out("max", F.col("_max"), unc, F.lit(0.0)), out("weighted", F.col("_sw") / F.col("_w"), unc, F.lit(0.0)), out("ds", score, F.coalesce(f[n], F.lit(0.0)), F.col("_conflict")))
    long = rows.select(record, "scenario", unc.alias("uncertainty"), F.explode(methods).alias("m"))
    return long.select(record, "scenario", "m.method", "m.score", "uncertainty", "m.ignorance", "m.conflict")


def sensitivity(scored: DataFrame, record: str, base: str = "base", scenarios: list[str] | None = None) -> DataFrame:
    """(method, scenario, records, mean_change, max_change) of scores against ``base``, for each of ``scenarios`` that is there.

    Without names, those that occur, a few, are asked for first. A record's scores by a method meet in one aggregate of
    fixed width; rows of ``method_scores`` lie by record already."""
    names = scenarios or [r[0] for r in scored.select("scenario").distinct().collect()]
    others = [n for n in names if n != base]
    of = lambda n: F.col("scenario") == n
    there = [F.max(F.when(of(n), F.lit(1))).alias(f"_n{i}") for i, n in enumerate(others)]
    wide = scored.groupBy(record, "method").agg(F.max(F.when(of(base), F.col("score"))).alias("_b"), *[F.max(F.when(of(n), F.col("score"))).alias(f"_s{i}") for i, n in enumerate(others)], *there)
    each = F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(f"_s{i}").alias("score"), F.col(f"_n{i}").alias("n")) for i, n in enumerate(others)])
    change = wide.select("method", "_b", F.explode(each).alias("o")).where("o.n = 1").select("method", "o.scenario", F.abs(F.col("o.score") - F.col("_b")).alias("d"))
    return change.groupBy("method", "scenario").agg(F.count(F.lit(1)).alias("records"), F.avg("d").alias("mean_change"), F.max("d").alias("max_change"))


def required_protection(score: Column, uncertainty: Column, ignorance: Column, strength: float) -> Column:
    if not 0 <= strength <= 1:
        raise ValueError("strength must be in [0, 1]")
    return score + (1 - score) * strength * F.greatest(uncertainty, ignorance)


def candidates(spark, epsilons: list[float], coverages: list[float], category_sets: list[list[str]]) -> DataFrame:
    """The grid of policies, numbered in order."""
    if any(e <= 0 for e in epsilons) or any(not 0 <= c <= 1 for c in coverages):
        raise ValueError("epsilon must be positive and coverage in [0, 1]")
    rows = [(f"eps{e:g}_cov{c:g}_types{i}", float(e), float(c), list(t)) for i, (e, c, t) in enumerate((e, c, t) for e in epsilons for c in coverages for t in category_sets)]
    return spark.createDataFrame(rows, "policy_id string, epsilon double, coverage double, protected_types array<string>")


def profile(observations: DataFrame) -> DataFrame:
    """Of each policy the worst privacy, utility and latency seen, with how often and from what."""
    return observations.groupBy("policy_id").agg(F.min("privacy").alias("privacy"), F.min("utility").alias("utility"), F.max("latency_ms").alias("latency_ms"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("provenance")), ",").alias("provenance"))


def choose(risks: DataFrame, policies: DataFrame, profiles: DataFrame, strength: float, utility_min: float, max_latency_ms: float, fixed: str | None = None) -> DataFrame:
    """``risks`` with the feasible policy of least latency, then id, or none and action block.

    Policies and profiles are configuration, a few rows, and are broadcast."""
    known = policies.join(profiles.select("policy_id", "privacy", "utility", "latency_ms"), "policy_id", "left")
    if fixed is not None:
        known = known.where(F.col("policy_id") == fixed)
    r = risks.withColumn("required", required_protection(F.col("score"), F.col("uncertainty"), F.col("ignorance"), strength))
    covered = F.array_contains("protected_types", "*") | (F.size(F.array_except("entity_types", "protected_types")) == 0)
    ok = (F.col("privacy") >= F.col("required")) & (F.col("utility") >= utility_min) & (F.col("latency_ms") <= max_latency_ms) & covered & (F.col("coverage") >= F.col("required"))
    j = r.crossJoin(F.broadcast(known)).withColumn("ok", F.coalesce(ok, F.lit(False)))
    best = F.min(F.when(F.col("ok"), F.struct("latency_ms", "policy_id"))).alias("best")
    g = j.groupBy("record_id", "required").agg(best, F.count_if("ok").alias("n_feasible"))
    return g.select("record_id", "required", "n_feasible", F.col("best.policy_id").alias("policy_id"), F.col("best.latency_ms").alias("latency_ms"), F.when(F.col("best").isNull(), "block").otherwise("apply_policy").alias("action"))
