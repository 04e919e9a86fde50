"""Queries over allocation by tags, user code, traces, consistency and further reports."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from veilmark.functions import probs as P
from veilmark.functions.text import filled
from veilmark.operators import allocation, corpus, hooks, labeling, labelmodel, metrics
from veilmark.plans.data import _SPLIT, docs, split
from veilmark.plans.fixtures import EV, TQ, VOTES, em_cte, records, table, tq, votes_cte
from veilmark.plans.labels import _votes
from veilmark.plans.registry import query
from veilmark.plans.scores import _DRAWS, _P10, draws, probs
from veilmark.scratch import checkpoint_dir, cut, drop

RATIOS = {"train": 0.7, "validation": 0.1, "calibration": 0.1, "test": 0.1}


def tagged(spark, sf):
    """Documents in groups of four ids side by side, tagged with their language and whether they are long."""
    d = docs(spark, sf).select("doc_id", "source", "lang", "n_chars")
    tags = F.array_compact(F.array(F.concat(F.lit("lang_"), "lang"), F.when(F.col("n_chars") > 4000, "long"), F.when(F.col("n_chars") > 40000, "very_long")))
    return d.select("doc_id", F.floor(F.col("doc_id") / 4).cast("string").alias("g"), F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(tags).alias("tags"))


_TAGS = """tg AS (SELECT (doc_id // 4)::VARCHAR AS g, doc_id % 5 = 0 AS bare, lang, n_chars FROM documents),
tt AS (SELECT g, 'lang_' || lang AS tag FROM tg WHERE NOT bare UNION SELECT g, 'long' FROM tg WHERE NOT bare AND n_chars > 4000 UNION SELECT g, 'very_long' FROM tg WHERE NOT bare AND n_chars > 40000
  UNION SELECT g, CASE WHEN bare THEN '__negative__' ELSE '__positive__' END FROM tg WHERE bare OR lang IS NOT NULL OR n_chars > 4000)"""


@query("f08_tag_targets", f"""WITH {_TAGS}, n AS (SELECT tag, count(*) AS n FROM tt WHERE tag IS NOT NULL GROUP BY tag),
r(split, share, place) AS (VALUES ('train', 0.7::DOUBLE, 0), ('test', 0.1, 1), ('validation', 0.1, 2), ('calibration', 0.1, 3)),
q AS (SELECT tag, n, split, floor(n * share) AS q, row_number() OVER (PARTITION BY tag ORDER BY floor(n * share) - n * share, place) AS k, n - sum(floor(n * share)) OVER (PARTITION BY tag) AS rest, place FROM n, r),
t AS (SELECT tag, n, split, place, q + (k <= rest)::INT AS target FROM q)
SELECT tag, split, target::BIGINT AS target FROM t WHERE n >= 40""")
def f08_targets(spark, sf):
    """Targets of tags of forty groups or more, where nobody has to lend a place to another split."""
    groups = allocation.tagged_groups(tagged(spark, sf), "g", "tags", "f8")
    counts = {r["tag"]: r["n"] for r in groups.select(F.explode("signature").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(t, s, n) for t, q in allocation.tag_targets(counts, RATIOS).items() if counts[t] >= 40 for s, n in q.items()]
    return spark.createDataFrame(rows, "tag string, split string, target long")


@query("f08_rarest_first")
def f08(spark, sf):
    done = allocation.rarest_first_split(tagged(spark, sf), "g", "tags", RATIOS, "f8")
    return done.select(F.explode("tags").alias("tag"), "split", "g").distinct().groupBy("tag", "split").agg(F.count(F.lit(1)).alias("groups"))


@query("f10_nested_order", f"""WITH RECURSIVE {_TAGS}, sg AS (SELECT g, list_sort(list(tag)) AS sig FROM tt WHERE tag IS NOT NULL GROUP BY g), dn AS (SELECT g, count(*) AS docs FROM tg GROUP BY g),
sx AS (SELECT sg.g, sig, docs, sha256(concat_ws('|', 'f10', sg.g)) AS d FROM sg JOIN dn ON dn.g = sg.g),
td AS (SELECT 'lang_' || lang AS tag FROM tg WHERE NOT bare AND lang IS NOT NULL UNION ALL SELECT 'long' FROM tg WHERE NOT bare AND n_chars > 4000 UNION ALL SELECT 'very_long' FROM tg WHERE NOT bare AND n_chars > 40000),
su AS (SELECT tag, count(*) AS n FROM td GROUP BY tag), fe AS (SELECT coalesce(list(tag), []) AS few FROM su WHERE n <= 10),
sr AS (SELECT sx.*, list_has_any(sig, few) AS rare FROM sx, fe),
ft AS (SELECT tag, n, row_number() OVER (ORDER BY n, tag) AS k, arg_min(g, (d, g)) AS g, arg_min(sig, (d, g)) AS sig FROM (SELECT sx.g, sx.sig, sx.d, unnest(sx.sig) AS tag FROM sx) JOIN su USING (tag) GROUP BY tag, n),
rc AS (SELECT 0::BIGINT AS k, (SELECT coalesce(list_distinct(flatten(list(sig))), []) FROM sr WHERE rare) AS covered, []::VARCHAR[] AS picks
  UNION ALL SELECT rc.k + 1, CASE WHEN list_contains(covered, tag) THEN covered ELSE list_concat(covered, ft.sig) END, CASE WHEN list_contains(covered, tag) THEN picks ELSE list_append(picks, ft.g) END FROM rc JOIN ft ON ft.k = rc.k + 1),
pk AS (SELECT picks FROM rc ORDER BY k DESC LIMIT 1),
tn AS (SELECT sr.*, CASE WHEN rare THEN 0 WHEN list_contains(picks, g) THEN 1 ELSE 2 END AS turn, list_position(picks, g) - 1 AS number FROM sr, pk),
pl AS (SELECT *, row_number() OVER (PARTITION BY turn, sig ORDER BY d, g) AS place, count(*) OVER (PARTITION BY turn, sig) AS m FROM tn)
SELECT g AS group_id, docs, row_number() OVER (ORDER BY turn, CASE turn WHEN 0 THEN 0 WHEN 1 THEN number::DOUBLE ELSE (place - 0.5::DOUBLE) / m END, d, g) AS rank, turn < 2 AS anchor FROM pl""")
def f10(spark, sf):
    return allocation.nested_order(tagged(spark, sf), "g", "tags", "f10").withColumnRenamed("g", "group_id")


def _posteriors(spark, sf):
    v, m = _votes(spark, sf, "sensitivity")
    patterns, _ = labelmodel.fit(v, "votes", m, 3)
    return labelmodel.apply(v, "votes", patterns)


@query("j10_consistency", f"""WITH {TQ} SELECT record_id, CASE WHEN record_id % 89 = 1 THEN 'not stored' WHEN record_id % 97 = 2 THEN 'votes' ELSE 'posterior' END AS reason
FROM tq WHERE record_id % 89 = 1 OR record_id % 97 = 2 OR record_id % 101 = 3""")
def j10(spark, sf):
    """A stored table in which some records are missing and others were changed, against votes and posteriors made again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    good = _posteriors(spark, sf).select("record_id", "votes", "probabilities")
    bad = good.where("record_id % 89 <> 1").withColumns(
        {
            "votes": F.when(F.col("record_id") % 97 == 2, F.transform("votes", lambda v: v + 1)).otherwise(F.col("votes")),
            "probabilities": F.when(F.col("record_id") % 101 == 3, F.reverse(F.transform("probabilities", lambda p, i: p + i * 0.01))).otherwise(F.col("probabilities")),
        }
    )
    bad.write.parquet(path)
    found = cut(labeling.inconsistent(spark.read.parquet(path), good, "record_id", "votes", "probabilities").select("record_id", "reason"))
    drop(spark, path)
    return found


@query("b13_text_encoder", "SELECT doc_id, length(coalesce(text, ''))::FLOAT AS x, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::FLOAT AS y FROM documents")
def b13(spark, sf):
    load = lambda: lambda texts: [[len(t), t.count("e")] for t in texts]  # noqa: E731  stands for a model
    v = hooks.encode_texts(docs(spark, sf).select("doc_id", "text"), load, "v", "text", batch=256)
    return v.select("doc_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


@query("m02_stage_observer", "SELECT 'raw' AS stage, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents UNION ALL SELECT 'english', count(*), sum(n_chars)::BIGINT FROM documents WHERE lang = 'en'")
def m02(spark, sf):
    watcher = hooks.StageObserver()
    raw = watcher.watch(docs(spark, sf).select("doc_id", "lang", "n_chars"), "raw", chars=F.sum("n_chars"))
    watcher.watch(raw.where("lang = 'en'"), "english", chars=F.sum("n_chars")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(s, m["rows"], m["chars"]) for s, m in watcher.report().items()], "stage string, rows long, chars long")


@query("m03_policy_evaluator", "SELECT o_orderkey, policy_id, round(strength / (1 + o_totalprice::DOUBLE / 100000), 9) AS privacy FROM orders, (VALUES ('weak', 0.35::DOUBLE), ('strong', 0.9)) AS p(policy_id, strength)")
def m03(spark, sf):
    cases = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    policies = spark.createDataFrame([("weak", 0.35), ("strong", 0.9)], "policy_id string, strength double")

    def judge(strength: pd.Series, price: pd.Series) -> pd.Series:
        return strength / (1 + price / 100000)

    return hooks.evaluate_policies(cases, policies, judge, ["strength", "price"], "double").select("o_orderkey", "policy_id", F.round("observation", 9).alias("privacy"))


@query("m04_extractors", """SELECT 'documents' AS source_dataset, coalesce(lang, '') AS domain, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY ALL
UNION ALL SELECT 'conversations', coalesce(role, ''), count(*), sum(length(coalesce(text, '')))::BIGINT FROM conversations GROUP BY ALL UNION ALL SELECT 'benchmark', 'questions', count(*), sum(length(coalesce(text, '')))::BIGINT FROM benchmark""")
def m04(spark, sf):
    known = hooks.Extractors()

    @known.register("documents")
    def of_documents(t):
        return t.select(filled("text").alias("query_text"), F.lit("").alias("context_text"), filled("lang").alias("domain"))

    @known.register("conversations")
    def of_conversations(t):
        return t.select(filled("text").alias("query_text"), F.concat_ws(":", "conv_id", "turn").alias("context_text"), filled("role").alias("domain"))

    @known.register("benchmark")
    def of_benchmark(t):
        return t.select(filled("text").alias("query_text"), F.lit("").alias("context_text"), F.lit("questions").alias("domain"))

    made = known.extract({n: table(spark, sf, n) for n in known.known})
    return made.groupBy("source_dataset", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("query_text")).alias("chars"))


@query("b34_stage_trace", r"""WITH few AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 10 = 0 AND doc_id < 2000 AND regexp_full_match(coalesce(text, ''), '(?s)[\x00-\x7F]*')),
c AS (SELECT doc_id, t, trim(regexp_replace(t, '[\s\x0B\x1C-\x1F]+', ' ', 'g')) AS u FROM few)
SELECT doc_id, 0 AS step, 'collapse' AS stage, t AS before, u AS after FROM c UNION ALL SELECT doc_id, 1, 'lower', u, lower(u) FROM c
UNION ALL SELECT doc_id, 2, 'drop_short', lower(u), CASE WHEN length(u) >= 80 THEN lower(u) END FROM c""")
def b34(spark, sf):
    """A batch of documents through three stages."""
    from veilmark.functions.text import collapsed

    few = docs(spark, sf).where("doc_id % 10 = 0 and doc_id < 2000").select("doc_id", filled("text").alias("t")).where(F.col("t").rlike(r"\A\p{ASCII}*\z"))
    stages = {"collapse": lambda d: d.withColumn("t", collapsed("t")), "lower": lambda d: d.withColumn("t", F.lower("t")), "drop_short": lambda d: d.where(F.length("t") >= 80)}
    return hooks.stage_trace(few, "doc_id", "t", stages)


_LV = votes_cte("intent") + ", k AS (SELECT domain, len(list_filter([v0, v1, v2, v3, v4], lambda x: x >= 0)) AS k, len(list_distinct(list_filter([v0, v1, v2, v3, v4], lambda x: x >= 0))) AS kinds FROM vt)"


@query("e07_vote_overlap", f"WITH {_LV} SELECT coalesce('domain/' || domain, 'all') AS grp, count(*) AS n, round(avg((k > 1)::INT), 9) AS overlap, round(avg((kinds > 1)::INT), 9) AS conflict, round(avg((k = 0)::INT), 9) AS all_abstain FROM k GROUP BY ROLLUP (domain)")
def e07_overlap(spark, sf):
    v, _ = _votes(spark, sf, "intent")
    d = labeling.vote_diagnostics(v, "votes", ["domain"])
    return d.select("grp", "n", *[F.round(c, 9).alias(c) for c in ("overlap", "conflict", "all_abstain")])


_ARG = lambda p: "CASE " + " ".join("WHEN " + " AND ".join(f"{p}{k} >= {p}{o}" for o in range(5) if o != k) + f" THEN {k}" for k in range(5)) + " END"
_ON5 = " AND ".join(f"vt.v{j} = post.v{j}" for j in range(5))


@query("e07_class_support", "WITH " + em_cte("intent", 5) + f""", b AS (SELECT [vt.v0, vt.v1, vt.v2, vt.v3, vt.v4] AS v, p0, p1, p2, p3, p4, {', '.join(f'len(list_filter([vt.v0, vt.v1, vt.v2, vt.v3, vt.v4], lambda x: x = {k})) AS c{k}' for k in range(5))} FROM vt JOIN post ON {_ON5}),
m AS (SELECT v, len(list_filter(v, lambda x: x >= 0)) > 0 AS voted_at_all, {_ARG('c')} AS m, {_ARG('p')} AS f FROM b)
SELECT k::INT AS class, sum(len(list_filter(v, lambda x: x = k)))::BIGINT AS fired, count(*) FILTER (WHERE list_contains(v, k)) AS voted, count(*) FILTER (WHERE voted_at_all AND m = k) AS majority,
  count(*) FILTER (WHERE voted_at_all AND f = k) AS final, count(*) FILTER (WHERE voted_at_all AND (m = k) <> (f = k)) AS differs FROM m, generate_series(0, 4) AS g(k) GROUP BY k""")
def e07_support(spark, sf):
    v, m = _votes(spark, sf, "intent")
    patterns, _ = labelmodel.fit(v, "votes", m, 5)
    return labeling.class_support(labelmodel.apply(v, "votes", patterns), "votes", "probabilities", 5)


def _top(target: str, k: int) -> str:
    """SQL for the first class with most votes of a target."""
    votes = "[" + ", ".join(VOTES[target]) + "]"
    counts = [f"len(list_filter({votes}, lambda x: x = {c}))" for c in range(k)]
    return f"list_position([{', '.join(counts)}], list_max([{', '.join(counts)}])) - 1"


_ORG = "[" + ", ".join(VOTES["entity_tags/has_organization"]) + "]"


@query("e13_semantic_contradictions", f"""WITH {EV}, lb AS (SELECT domain, lt, ['general_information', 'personal_information_request', 'medical_information_request', 'financial_information_request', 'identity_related_request'][{_top('intent', 5)} + 1] AS intent,
  ['low', 'medium', 'high'][{_top('sensitivity', 3)} + 1] AS sensitivity, list_contains({_ORG}, 1) AND NOT list_contains({_ORG}, 0) AS organization FROM ev),
r AS (SELECT domain, 'medical_intent_elsewhere' AS rule FROM lb WHERE intent LIKE 'medical%' AND domain <> 'medical'
  UNION ALL SELECT domain, 'financial_intent_elsewhere' FROM lb WHERE intent LIKE 'financial%' AND domain <> 'financial' AND NOT regexp_matches(lt, 'tariff|tax|stock|trade')
  UNION ALL SELECT domain, 'identity_in_general_questions' FROM lb WHERE intent LIKE 'identity%' AND domain = 'general_qa'
  UNION ALL SELECT domain, 'sensitive_but_general' FROM lb WHERE intent LIKE 'general%' AND sensitivity = 'high'
  UNION ALL SELECT domain, 'medical_but_harmless' FROM lb WHERE intent LIKE 'medical%' AND sensitivity = 'low' AND domain = 'medical'
  UNION ALL SELECT domain, 'medical_intent_in_hops' FROM lb WHERE intent LIKE 'medical%' AND domain = 'multi_hop_qa'
  UNION ALL SELECT domain, 'organization_in_questions' FROM lb WHERE organization AND domain IN ('general_qa', 'multi_hop_qa')), n AS (SELECT domain, count(*) AS total FROM lb GROUP BY domain)
SELECT r.domain, rule, count(*) AS n, round(count(*) / any_value(total), 9) AS rate FROM r JOIN n USING (domain) GROUP BY r.domain, rule""")
def e13_rules(spark, sf):
    """Labels by majority of votes."""
    m = labeling.vote_matrix(records(spark, sf), ["intent", "sensitivity", "entity_tags/has_organization"])
    name = lambda t: F.element_at(F.array(*map(F.lit, labeling.TAXONOMY[t])), P.argmax(labeling.majority(F.col(f"votes_{t}"), len(labeling.TAXONOMY[t]))) + 1)
    org = labeling.majority(F.col("votes_entity_tags_has_organization"), 2)[1]
    rows = cut(m.select("domain", F.lower("normalized_text").alias("text"), name("intent").alias("intent"), name("sensitivity").alias("sensitivity"), org.alias("organization")))
    return labeling.contradictions(rows).withColumn("rate", F.round("rate", 9))


@query("i11_risk_coverage", f"WITH {_P10}, x AS (SELECT (label <> best)::INT AS e, row_number() OVER (ORDER BY round(1 - conf, 6), vec_id) AS r, count(*) OVER () AS n FROM bs), c AS (SELECT r, n, sum(e) OVER (ORDER BY r) / r AS risk FROM x) SELECT i::INT AS point, round(r / n, 9) AS coverage, round(risk, 9) AS risk FROM c JOIN generate_series(1, 100) AS g(i) ON r = (n * i + 99) // 100")
def i11_curve(spark, sf):
    d = probs(spark, sf).select("vec_id", (F.col("label") != F.col("best")).alias("e"), F.round(1 - F.col("conf"), 6).alias("u"))
    c = metrics.risk_coverage_curve(d, "e", "u", ["vec_id"])
    return c.select("point", F.round("coverage", 9).alias("coverage"), F.round("risk", 9).alias("risk"))


@query("i23_masked_loss", f"WITH {_P10} SELECT count(*) FILTER (WHERE label <> 9) AS observed, round(avg((best = label)::INT) FILTER (WHERE label <> 9), 9) AS agreement, round(avg(-ln(greatest(p[label + 1], 1e-12))) FILTER (WHERE label <> 9), 7) AS loss FROM bs")
def i23_loss(spark, sf):
    got = metrics.masked_agreement(probs(spark, sf), "p", "label", F.col("label") != 9)
    return got.select("observed", F.round("agreement", 9).alias("agreement"), F.round("loss", 7).alias("loss"))


@query("i25_budget_stability", f"""WITH {_DRAWS}, s(budget) AS (VALUES (2), (4), (6)), m AS (SELECT vec_id, budget, k, avg(p) AS m FROM dl, s WHERE pass < budget GROUP BY ALL),
f AS (SELECT vec_id, budget, arg_max(k, m) AS best FROM m GROUP BY ALL)
SELECT a.budget, round(avg(abs(a.m - b.m)), 7) AS delta, round(avg((x.best = y.best)::INT), 9) AS agreement FROM m a JOIN m b ON a.vec_id = b.vec_id AND a.k = b.k AND b.budget = 6
JOIN f x ON x.vec_id = a.vec_id AND x.budget = a.budget JOIN f y ON y.vec_id = a.vec_id AND y.budget = 6 GROUP BY a.budget""")
def i25_stability(spark, sf):
    s = metrics.budget_stability(draws(spark, sf), ["vec_id"], "pass", "probs", [2, 4, 6])
    return s.select("budget", F.round("delta", 7).alias("delta"), F.round("agreement", 9).alias("agreement"))


@query("i22_candidates_compared", f"""WITH {_P10}, c AS (SELECT 'nll' AS metric, round(avg(-ln(greatest(p[label + 1], 1e-12))), 6) AS a, round(avg(-ln(greatest(p[label + 1], 1e-12))) FILTER (WHERE vec_id % 2 = 0), 6) AS b FROM bs
UNION ALL SELECT 'accuracy', round(avg((label = best)::INT), 6), round(avg((label = best)::INT) FILTER (WHERE vec_id % 2 = 0), 6) FROM bs UNION ALL SELECT 'only_whole', round(count(*), 6), NULL FROM bs)
SELECT metric, a AS before, b AS after, round(b - a, 6) AS change, abs(b - a) <= 0.01 AS within FROM c""")
def i22_compared(spark, sf):
    """Half of the rows against all of them; a metric that one side lacks gives nulls."""

    def measured(p, whole):
        out = metrics.token_scores(p, "p", "label").select(F.lit("nll").alias("metric"), F.round("nll", 6).alias("value"))
        out = out.unionByName(metrics.single_label(p, "label", "best").select(F.lit("accuracy").alias("metric"), F.round("accuracy", 6).alias("value")))
        return out.unionByName(p.agg(F.lit("only_whole").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))) if whole else out

    p = cut(probs(spark, sf).select("vec_id", "label", "p", "best"))
    d = metrics.metric_changes(measured(p, True), measured(p.where("vec_id % 2 = 0"), False), "metric", "value", 0.01)
    return d.withColumn("change", F.round("change", 6))


@query("j03_generated_rows", f"WITH {_SPLIT} SELECT split, count(*) AS n FROM sp WHERE source = 'src3' AND split <> 'train' GROUP BY split")
def j03_rows(spark, sf):
    """Rows of a source that stands for generated ones, outside of train."""
    from veilmark.operators.groups import misplaced

    return misplaced(split(spark, sf), F.col("source") == "src3", "split", ["train"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("j12_nested_breaks", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws('|', 'n1', doc_id::VARCHAR))) AS r, count(*) OVER () AS n FROM documents) WHERE r <= ceil(n * 0.25::DOUBLE) AND doc_id % 17 = 0")
def j12_breaks(spark, sf):
    """Of the subset of a quarter, what a half that lost some rows does not hold."""
    n = corpus.nested_subsets(docs(spark, sf), "doc_id", "n1", [0.25, 0.5])
    small, large = n.where("fraction = 0.25").select("doc_id"), n.where("fraction = 0.5 and doc_id % 17 <> 0").select("doc_id")
    return small.join(large.hint("merge"), "doc_id", "left_anti")
