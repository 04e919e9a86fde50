"""Queries over the template corpus: cleaning, evidence, votes, label model and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import probs as P
from veilmark.functions.text import cleaned, folded
from veilmark.operators import corpus, evidence, labeling, labelmodel, metrics
from veilmark.plans.fixtures import CL, EV, TQ, VOTES, em_cte, records, table, tq, votes_cte
from veilmark.plans.registry import query
from veilmark.scratch import cut

R9 = lambda c: F.round(c, 9)
SHORT = {"sensitivity": "c05_sensitivity_votes", "intent": "c06_intent_votes", "disclosure_scope": "c07_disclosure_votes"}


@query("b04_clean", "WITH " + CL + " SELECT record_id, query_text, context_text, nt AS normalized_text, length(query_text) < 3 AS is_short_text FROM cl")
def b04_clean(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus.clean_records(tq(spark, sf))
    return c.select("record_id", "query_text", "context_text", "normalized_text", "is_short_text")


@query("b03_collapse_documents", r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0B\x1C-\x1F]+', ' ', 'g'))) AS digest FROM documents")
def b03_collapse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(cleaned("text")).alias("digest"))


@query("b05_drop_short", "WITH " + CL + " SELECT domain, count(*) AS n FROM cl WHERE length(query_text) >= 30 GROUP BY domain")
def b05_drop_short(spark, sf):
    return corpus.drop_short(corpus.clean_records(tq(spark, sf), nfkc=False), 30).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("b06_dedup_key", "SELECT count(DISTINCT lower(coalesce(text, ''))) AS n_lower, count(DISTINCT replace(lower(coalesce(text, '')), 'ß', 'ss')) AS n_folded FROM documents")
def b06_key(spark, sf):
    return table(spark, sf, "documents").agg(F.countDistinct(F.lower(F.coalesce("text", F.lit("")))).alias("n_lower"), F.countDistinct(folded("text")).alias("n_folded"))


@query("b07_regex_hits", "WITH " + EV + " SELECT record_id, h_email AS email, h_phone AS phone, h_money AS money, h_date AS date, h_url AS url, h_account_number AS account_number FROM ev")
def b07_hits(spark, sf):
    return records(spark, sf).select("record_id", *[evidence.hits(n).alias(n) for n in evidence.PATTERNS])


@query("b10_name_entities", "WITH " + EV + " SELECT record_id, array_to_string(names, '|') AS names FROM (SELECT record_id, list_sort(names) AS names FROM ev)")
def b10_names(spark, sf):
    names = F.array_sort(F.transform(evidence.name_entities(F.col("normalized_text")), lambda e: e["text"]))
    return corpus.clean_records(tq(spark, sf), nfkc=False).select("record_id", F.array_join(names, "|").alias("names"))


@query("b12_hashing_embedding", r"""WITH """ + CL + r""", w AS (SELECT record_id, unnest(string_split_regex(lt, '\s+')) AS word FROM cl WHERE record_id <= 300),
h AS (SELECT record_id, ('0x' || substr(sha256(word), 1, 8))::BIGINT % 384 AS dim, CASE WHEN ('0x' || substr(sha256(word), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM w WHERE word <> ''),
v AS (SELECT record_id, dim, sum(s)::DOUBLE AS v FROM h GROUP BY ALL HAVING sum(s) <> 0)
SELECT record_id, dim::INT AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY record_id)), 9) AS value FROM v""".replace(" WHERE record_id <= 300", ""))
def b12_embedding(spark, sf):
    c = corpus.clean_records(tq(spark, sf), nfkc=False)
    return evidence.hashing_embedding(c, "record_id", "normalized_text").select("record_id", "dim", R9(F.col("value")).alias("value"))


@query("b14_contains_terms", "WITH " + CL + " SELECT record_id, " + VOTES["sensitivity"][0].replace("THEN 2 ELSE -1", "THEN true ELSE false") + " AS medical FROM cl")
def b14_terms(spark, sf):
    return corpus.clean_records(tq(spark, sf), nfkc=False).select("record_id", labeling.term("medical").alias("medical"))


def _votes(spark, sf, target):
    m, name = len(VOTES[target]), f"votes_{target.replace('/', '_')}"
    #: what is read more than once is made once
    return cut(labeling.vote_matrix(records(spark, sf), [target]).select("record_id", "domain", F.col(name).alias("votes"))), m


def _register_votes(name: str, target: str) -> None:
    m = len(VOTES[target])

    @query(name, f"WITH {votes_cte(target)} SELECT record_id, " + ", ".join(f"v{j}" for j in range(m)) + " FROM vt")
    def votes(spark, sf):
        v, _ = _votes(spark, sf, target)
        return v.select("record_id", *[F.col("votes")[j].alias(f"v{j}") for j in range(m)])


for _t in VOTES:
    _register_votes(SHORT.get(_t) or ("c04_" if _t.startswith("entity") else {"re_identification": "c08_", "attribute_inference": "c09_", "membership_inference": "c10_"}[_t.split("/")[1]]) + _t.split("/")[1] + "_votes", _t)


@query("c14_vote_matrix", "WITH " + EV + " SELECT record_id, concat_ws(',', " + ", ".join(e for t in labeling.targets() for e in VOTES[t]) + ") AS votes FROM ev")
def c14_matrix(spark, sf):
    m = labeling.vote_matrix(records(spark, sf))
    return m.select("record_id", F.array_join(F.transform(F.concat(*[F.col(f"votes_{t.replace('/', '_')}") for t in labeling.targets()]), lambda v: v.cast("string")), ",").alias("votes"))


def _long(target: str) -> str:
    return votes_cte(target) + ", lv AS (" + " UNION ALL ".join(f"SELECT record_id, domain, {j} AS j, v{j} AS v FROM vt" for j in range(len(VOTES[target]))) + "), kinds AS (SELECT record_id, count(DISTINCT v) FILTER (WHERE v >= 0) AS kinds FROM lv GROUP BY record_id)"


_NAMES = ["lf_sensitivity_medical_terms", "lf_sensitivity_financial_terms", "lf_sensitivity_credential_terms", "lf_sensitivity_high_entity_and_account", "lf_sensitivity_numeric_financial_pattern", "lf_sensitivity_contact_identifier_present", "lf_sensitivity_default_low"]
_NAME_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


@query("e05_lf_coverage", "WITH " + _long("sensitivity") + f" SELECT domain AS grp, {_NAME_LIST}[j + 1] AS lf, round(avg((v >= 0)::INT), 9) AS coverage, round(avg((v >= 0 AND kinds > 1)::INT), 9) AS conflict, count(*) AS n FROM lv JOIN kinds USING (record_id) GROUP BY domain, j")
def e05_coverage(spark, sf):
    v, _ = _votes(spark, sf, "sensitivity")
    r = labeling.lf_report(v, "votes", _NAMES, by="domain")
    return r.select("grp", "lf", R9("coverage").alias("coverage"), R9("conflict").alias("conflict"), "n")


@query("e06_conflict", "WITH " + _long("intent") + " SELECT count(*) AS n, round(avg((kinds > 1)::INT), 9) AS conflict_ratio, round(avg((kinds = 0)::INT), 9) AS all_abstain_ratio FROM kinds")
def e06_conflict(spark, sf):
    v, _ = _votes(spark, sf, "intent")
    return labeling.matrix_report(v, "votes").select("n", R9("conflict_ratio").alias("conflict_ratio"), R9("all_abstain_ratio").alias("all_abstain_ratio"))


@query("f17_majority", "WITH " + votes_cte("intent") + ", c AS (SELECT record_id, " + ", ".join(f"(len(list_filter([v0, v1, v2, v3, v4], lambda x: x = {k})))::DOUBLE AS c{k}" for k in range(5)) + " FROM vt) SELECT record_id, " + ", ".join(f"CASE WHEN c0 + c1 + c2 + c3 + c4 > 0 THEN round(c{k} / (c0 + c1 + c2 + c3 + c4), 9) ELSE 0.2 END AS p{k}" for k in range(5)) + " FROM c")
def f17_majority(spark, sf):
    v, _ = _votes(spark, sf, "intent")
    p = labeling.majority(F.col("votes"), 5)
    return v.select("record_id", *[R9(p[k]).alias(f"p{k}") for k in range(5)])


def _em(name: str, target: str, k: int, update_mu: bool = False) -> None:
    m = len(VOTES[target])
    on = " AND ".join(f"vt.v{j} = post.v{j}" for j in range(m))

    @query(name, f"WITH {em_cte(target, k, update_mu=update_mu)} SELECT record_id, " + ", ".join(f"round(p{c}, 7) AS p{c}" for c in range(k)) + f" FROM vt JOIN post ON {on}")
    def posterior(spark, sf):
        v, _ = _votes(spark, sf, target)
        patterns, _fit = labelmodel.fit(v, "votes", m, k, update_mu=update_mu)
        return labelmodel.apply(v, "votes", patterns).select("record_id", *[F.round(F.col("probabilities")[c], 7).alias(f"p{c}") for c in range(k)])


_em("h01_label_model", "sensitivity", 3)
_em("h05_label_model_intent", "intent", 5)
_em("h05_label_model_disclosure", "disclosure_scope", 2)
_em("h04_entity_tags_person", "entity_tags/has_person", 2)
_em("h04_entity_tags_organization", "entity_tags/has_organization", 2)
_em("h04_entity_tags_location", "entity_tags/has_location", 2)
_em("h04_entity_tags_contact", "entity_tags/has_contact_identifier", 2)
_em("h04_threat_reid", "threat_content/re_identification", 2)
_em("h04_threat_attribute", "threat_content/attribute_inference", 2)
_em("h04_threat_membership", "threat_content/membership_inference", 2)
_em("h11_label_model_refit_prior", "intent", 5, update_mu=True)


@query("h02_inference", "WITH " + em_cte("sensitivity", 3, rounds=1) + " SELECT record_id, " + ", ".join(f"round(p{c}, 9) AS p{c}" for c in range(3)) + " FROM vt JOIN post ON " + " AND ".join(f"vt.v{j} = post.v{j}" for j in range(7)))
def h02_inference(spark, sf):
    v, m = _votes(spark, sf, "sensitivity")
    return labelmodel.infer(v, "votes", [0.7] * m, 3).select("record_id", *[R9(F.col("probabilities")[c]).alias(f"p{c}") for c in range(3)])


_BEST3 = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"


@query("h03_lf_accuracy", "WITH " + em_cte("sensitivity", 3) + f", b AS (SELECT *, {_BEST3} AS best FROM post) " + " UNION ALL ".join(f"SELECT {j} AS j, round(coalesce(sum(n) FILTER (WHERE v{j} >= 0 AND v{j} = best), CASE WHEN sum(n) FILTER (WHERE v{j} >= 0) IS NULL THEN NULL ELSE 0 END) / sum(n) FILTER (WHERE v{j} >= 0), 9) AS accuracy FROM b" for j in range(7)))
def h03_accuracy(spark, sf):
    v, m = _votes(spark, sf, "sensitivity")
    patterns, _ = labelmodel.fit(v, "votes", m, 3)
    return labelmodel.empirical_accuracy(patterns, m).select("j", R9("accuracy").alias("accuracy"))


def _labelled(spark, sf, target="sensitivity", k=3):
    v, m = _votes(spark, sf, target)
    patterns, _ = labelmodel.fit(v, "votes", m, k)
    return labelmodel.apply(v, "votes", patterns)


_J3 = "WITH " + em_cte("sensitivity", 3) + ", lab AS (SELECT record_id, domain, p0, p1, p2 FROM vt JOIN post ON " + " AND ".join(f"vt.v{j} = post.v{j}" for j in range(7)) + ")"
_H3 = "-(" + " + ".join(f"greatest(p{c}, 1e-12) * ln(greatest(p{c}, 1e-12))" for c in range(3)) + ")"


@query("e11_posterior_diagnostics", _J3 + f", x AS (SELECT domain, {_H3} AS h, greatest(p0, p1, p2) AS c FROM lab) SELECT coalesce(domain, '(all)') AS grp, count(*) AS n, round(avg(h), 7) AS mean_entropy, round(avg(c), 7) AS mean_max_confidence, count(*) FILTER (WHERE c < 0.6) AS n_uncertain FROM x GROUP BY ROLLUP (domain)")
def e11_diagnostics(spark, sf):
    d = metrics.posterior_diagnostics(_labelled(spark, sf), "probabilities", "domain")
    return d.select("grp", "n", F.round("mean_entropy", 7).alias("mean_entropy"), F.round("mean_max_confidence", 7).alias("mean_max_confidence"), "n_uncertain")


@query("e08_label_distribution", _J3 + f", t(idx, label) AS (VALUES (0, 'low'), (1, 'medium'), (2, 'high')), b AS (SELECT {_BEST3} AS best FROM lab) SELECT label, count(best) AS n FROM t LEFT JOIN b ON best = idx GROUP BY label")
def e08_distribution(spark, sf):
    names = spark.createDataFrame(list(enumerate(labeling.TAXONOMY["sensitivity"])), "idx int, label string")
    got = _labelled(spark, sf).groupBy(P.argmax(F.col("probabilities")).alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(got, "idx", "left").select("label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("e09_category_stats", "WITH " + em_cte("threat_content/re_identification", 2) + ", lab AS (SELECT p1 AS p FROM vt JOIN post ON " + " AND ".join(f"vt.v{j} = post.v{j}" for j in range(4)) + ") SELECT round(avg(p), 7) AS mean, round(stddev_pop(p), 7) AS std, round(min(p), 7) AS min, round(max(p), 7) AS max, " + ", ".join(f"round(quantile_cont(p, {q}), 7) AS q{int(q * 100):02d}" for q in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) + ", " + ", ".join(f"count(*) FILTER (WHERE p > {t}) AS above_{int(t * 10)}" for t in (0.5, 0.6, 0.8, 0.9)) + " FROM lab")
def e09_stats(spark, sf):
    p = F.col("probabilities")[1]
    qs = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
    d = _labelled(spark, sf, "threat_content/re_identification", 2).select(p.alias("p"))
    r7 = lambda c, n: F.round(c, 7).alias(n)
    return d.agg(r7(F.avg("p"), "mean"), r7(F.stddev_pop("p"), "std"), r7(F.min("p"), "min"), r7(F.max("p"), "max"), *[r7(F.percentile("p", F.lit(q)), f"q{int(q * 100):02d}") for q in qs], *[F.count_if(F.col("p") > t).alias(f"above_{int(t * 10)}") for t in (0.5, 0.6, 0.8, 0.9)])


@query("e12_label_by_domain", _J3 + f", b AS (SELECT domain, {_BEST3} AS best FROM lab) SELECT domain, count(*) FILTER (WHERE best = 0) AS low, count(*) FILTER (WHERE best = 1) AS medium, count(*) FILTER (WHERE best = 2) AS high FROM b GROUP BY domain")
def e12_cross(spark, sf):
    names = labeling.TAXONOMY["sensitivity"]
    d = _labelled(spark, sf).withColumn("label", F.element_at(F.array(*map(F.lit, names)), P.argmax(F.col("probabilities")) + 1))
    return d.groupBy("domain").pivot("label", names).agg(F.count(F.lit(1))).fillna(0)


@query("e15_quality_gate", _J3 + f", x AS (SELECT domain, {_H3} AS h, greatest(p0, p1, p2) AS c FROM lab), g AS (SELECT domain AS grp, avg(h) AS h, avg(c) AS c FROM x GROUP BY domain) SELECT grp FROM g WHERE h > 0.6 OR c < 0.8")
def e15_gate(spark, sf):
    d = metrics.posterior_diagnostics(_labelled(spark, sf), "probabilities", "domain")
    return d.where("grp <> '(all)' AND (mean_entropy > 0.6 OR mean_max_confidence < 0.8)").select("grp")


@query("b31_top_label", _J3 + f" SELECT record_id, {_BEST3} AS best, round(greatest(p0, p1, p2), 7) AS confidence, round({_H3} / ln(3), 7) AS normalised_entropy FROM lab")
def b31_top(spark, sf):
    p = F.col("probabilities")
    return _labelled(spark, sf).select("record_id", P.argmax(p).alias("best"), F.round(F.array_max(p), 7).alias("confidence"), F.round(P.normalised_entropy(p), 7).alias("normalised_entropy"))


@query("e01_domain_distribution", "WITH " + TQ + " SELECT domain, count(*) AS n FROM tq GROUP BY domain")
def e01_domains(spark, sf):
    return tq(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("e02_evidence_statistics", "WITH " + EV + " SELECT count(*) AS n, sum(n_ent)::BIGINT AS entities, " + ", ".join(f"count(*) FILTER (WHERE h_{n}) AS {n}" for n in evidence.PATTERNS) + " FROM ev")
def e02_statistics(spark, sf):
    return records(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("entities")).alias("entities"), *[F.count_if(evidence.hits(n)).alias(n) for n in evidence.PATTERNS])


@query("e04_audit", "WITH " + EV + " SELECT round(avg((n_ent > 0)::INT), 9) AS entity_coverage, round(avg(h_any::INT), 9) AS pattern_coverage, count(DISTINCT nt) AS distinct_texts, avg((n_ent > 0 OR h_any)::INT) >= 0.5 AS passed FROM ev")
def e04_audit(spark, sf):
    e, h = (F.size("entities") > 0), (F.size("regex_matches") > 0)
    share = lambda c: F.avg(c.cast("int"))
    return records(spark, sf).agg(R9(share(e)).alias("entity_coverage"), R9(share(h)).alias("pattern_coverage"), F.countDistinct("normalized_text").alias("distinct_texts"), (share(e | h) >= 0.5).alias("passed"))


@query("e14_rates_by_domain", "WITH " + EV + " SELECT domain, round(avg(e_person::INT), 9) AS person_rate, round(avg(n_ent), 9) AS mean_entities FROM ev GROUP BY domain")
def e14_rates(spark, sf):
    return records(spark, sf).groupBy("domain").agg(R9(F.avg(labeling.labelled("PERSON").cast("int"))).alias("person_rate"), R9(F.avg(F.size("entities"))).alias("mean_entities"))


