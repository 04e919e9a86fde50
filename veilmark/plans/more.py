"""Queries over votes and splits together, group samples, query cues, attacks and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.functions import probs as P
from veilmark.operators import classifier, corpus, cues, evidence, groups, labeling, labelmodel, metrics, spans
from veilmark.operators import risk as R
from veilmark.plans.data import _SPLIT, docs, split
from veilmark.plans.fixtures import CL, em_cte, records, table, tq, votes_cte
from veilmark.plans.labels import _votes
from veilmark.plans.registry import query
from veilmark.plans.scores import _OK, _POL, _heads, policies, risks, temperature_sql

_GROUPS = "gg AS (SELECT source || (doc_id // 7)::VARCHAR AS g, count(*) AS n FROM documents GROUP BY 1), go AS (SELECT g, n, row_number() OVER (ORDER BY sha256(concat_ws('|', 'w1', g)), g) AS i FROM gg), gt AS (SELECT i, CASE WHEN n <= 100 THEN n ELSE 0 END AS s, n <= 100 AS taken FROM go WHERE i = 1 UNION ALL SELECT go.i, CASE WHEN gt.s + go.n <= 100 THEN gt.s + go.n ELSE gt.s END, gt.s + go.n <= 100 FROM gt JOIN go ON go.i = gt.i + 1)"


@query("f04_whole_group_sample", f"WITH RECURSIVE {_GROUPS} SELECT g, n FROM go JOIN gt USING (i) WHERE taken")
def f04(spark, sf):
    d = docs(spark, sf).select(F.concat("source", F.floor(F.col("doc_id") / 7).cast("string")).alias("g"))
    return corpus.whole_group_sample(d, "g", 100, "w1").groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("f05_exact_targets", f"WITH {_SPLIT} SELECT split, 40::BIGINT AS n FROM sp GROUP BY split")
def f05(spark, sf):
    s = split(spark, sf).withColumn("g", F.col("doc_id"))
    got = corpus.exact_targets(s, "split", "g", {"train": 40, "validation": 40, "test": 40}, "x1")
    return got.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("f07_quota_split", "SELECT source, split, (n // 20 * 20 * k // 10)::BIGINT AS n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source), (VALUES ('train', 7), ('validation', 1), ('calibration', 1), ('test', 1)) AS t(split, k) WHERE n >= 20")
def f07(spark, sf):
    """Each source is capped at a multiple of 20 rows, as exact quotas ask for, and comes in pairs."""
    d = docs(spark, sf).select("doc_id", "source")
    sizes = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    #: one row a source
    d = corpus.rank_within(d, ["source"], ["doc_id"], "r").join(F.broadcast(sizes), "source")
    d = d.where(F.col("r") <= F.floor(F.col("n") / 20) * 20).withColumn("g", F.concat_ws(":", "source", F.floor((F.col("r") - 1) / 2).cast("string")))
    got = corpus.quota_split(d, "source", "g", {"train": 7, "validation": 1, "calibration": 1, "test": 1}, "q1")
    return got.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("f14_reference_set", """WITH k AS (SELECT doc_id, source, lang, n_chars > 3000 AS long, sha256(concat_ws('|', 'r1', doc_id::VARCHAR)) AS d FROM documents),
v AS (SELECT source, greatest(1, 30 // count(*)) AS even FROM (SELECT DISTINCT source, lang, long FROM k) GROUP BY source),
p AS (SELECT k.*, row_number() OVER (PARTITION BY source, lang, long ORDER BY d, doc_id) AS place FROM k),
f AS (SELECT p.*, count(*) OVER (PARTITION BY p.source, lang, long) AS n FROM p JOIN v ON v.source IS NOT DISTINCT FROM p.source WHERE place <= even),
s AS (SELECT doc_id, source, long, CASE WHEN place <= greatest(1, floor(n * 2 / 3 + 1e-9)) THEN 'calibration' ELSE 'evaluation' END AS part FROM f),
g AS (SELECT source, count(*) FILTER (WHERE part = 'calibration') AS c, count(*) FILTER (WHERE part = 'evaluation') AS e FROM s GROUP BY source),
m AS (SELECT source, c, e, greatest(0, 20 - c) AS mc FROM g), m2 AS (SELECT *, greatest(0, 30 - (c + mc) - e) AS me FROM m),
r AS (SELECT k.doc_id, k.source, k.long, row_number() OVER (PARTITION BY k.source ORDER BY d, k.doc_id) AS place FROM k WHERE doc_id NOT IN (SELECT doc_id FROM s)),
t AS (SELECT r.doc_id, r.long, CASE WHEN place <= mc THEN 'calibration' WHEN place <= mc + me THEN 'evaluation' END AS part FROM r JOIN m2 ON m2.source IS NOT DISTINCT FROM r.source),
u AS (SELECT doc_id, long, part FROM s UNION ALL SELECT doc_id, long, part FROM t WHERE part IS NOT NULL)
SELECT doc_id, part, concat_ws(',', CASE WHEN long THEN 'long' END, CASE WHEN doc_id % 2 = 0 THEN 'even' END) AS priority FROM u""")
def f14(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", "lang", (F.col("n_chars") > 3000).alias("long"))
    got = corpus.reference_set(d, "source", ["lang", "long"], "doc_id", 30, "r1", tags={"long": F.col("long"), "even": F.col("doc_id") % 2 == 0})
    return got.select("doc_id", "part", F.array_join("priority", ",").alias("priority"))


@query("d01_label_tables", "WITH " + votes_cte("sensitivity") + ", a AS (SELECT record_id FROM vt WHERE v0 >= 0), b AS (SELECT record_id FROM vt WHERE v6 < 0) SELECT tq.record_id FROM tq JOIN a USING (record_id) JOIN b USING (record_id)")
def d01(spark, sf):
    v, _ = _votes(spark, sf, "sensitivity")
    long = v.select("record_id", F.explode(F.array_compact(F.array(F.when(F.col("votes")[0] >= 0, "a"), F.when(F.col("votes")[6] < 0, "b")))).alias("dimension"))
    wide = long.groupBy("record_id").agg(F.collect_set("dimension").alias("dims")).where(F.size("dims") == 2)
    return tq(spark, sf).join(wide.hint("merge"), "record_id").select("record_id")


@query("d04_uncertainty_lookup", "SELECT d.doc_id, coalesce(e.label, -1) AS level FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def d04(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return docs(spark, sf).join(e, "doc_id", "left").select("doc_id", F.coalesce("label", F.lit(-1)).alias("level"))


@query("d05_predictions_decisions", "SELECT l.doc_id, quality, toxic, lang FROM labels l JOIN documents d USING (doc_id)")
def d05(spark, sf):
    return table(spark, sf, "labels").join(docs(spark, sf), "doc_id").select("doc_id", "quality", "toxic", "lang")


@query("d09_risk_policy_pairs", f"WITH {_POL} SELECT policy_id, count(*) FILTER (WHERE {_OK}) AS feasible FROM rq, pol JOIN prof USING (policy_id) GROUP BY policy_id")
def d09(spark, sf):
    r, (p, f) = risks(spark, sf), policies(spark)
    out = None
    for name in ("weak", "medium", "strong"):
        d = R.choose(r, p, f, 0.5, 0.6, 20.0, fixed=name).agg(F.lit(name).alias("policy_id"), F.sum("n_feasible").alias("feasible"))
        out = d if out is None else out.unionByName(d)
    return out


@query("d10_unprofiled_policies", f"WITH {_POL} SELECT record_id, 'block' AS action FROM rq WHERE NOT (0.35 >= required AND 0.6 >= required) ")
def d10(spark, sf):
    p, f = policies(spark)
    got = R.choose(risks(spark, sf), p, f.where("policy_id = 'weak'"), 0.5, 0.6, 20.0)
    return got.where("action = 'block'").select("record_id", "action")


@query("e07_grouped_vote_diagnostics", "WITH " + votes_cte("intent") + ", lv AS (" + " UNION ALL ".join(f"SELECT domain, {j} AS j, v{j} AS v FROM vt" for j in range(5)) + ") SELECT coalesce(domain, '(all)') AS grp, j::INT AS j, count(*) FILTER (WHERE v >= 0) AS fired FROM lv GROUP BY GROUPING SETS ((j), (domain, j))")
def e07(spark, sf):
    v, _ = _votes(spark, sf, "intent")
    long = v.select("domain", F.posexplode("votes").alias("j", "v"))
    g = long.groupingSets([["j"], ["domain", "j"]], "domain", "j").agg(F.count_if(F.col("v") >= 0).alias("fired"))
    return g.select(F.coalesce("domain", F.lit("(all)")).alias("grp"), "j", "fired")


_TAGS = ("has_person", "has_organization", "has_location", "has_contact_identifier")


@query("e10_co_occurrence", "WITH " + votes_cte("entity_tags/has_person") + ", x AS (SELECT record_id, (e_person OR e_name)::INT + e_org::INT + e_loc::INT + (h_email OR h_phone OR h_account_number)::INT AS k FROM ev) SELECT least(k, 3) AS positives, count(*) AS n FROM x GROUP BY ALL")
def e10(spark, sf):
    r = labeling.vote_matrix(records(spark, sf), [f"entity_tags/{t}" for t in _TAGS])
    present = [F.exists(f"votes_entity_tags_{t}", lambda v: v == 1).cast("int") for t in _TAGS]
    return r.select(F.least(present[0] + present[1] + present[2] + present[3], F.lit(3)).alias("positives")).groupBy("positives").agg(F.count(F.lit(1)).alias("n"))


@query("e20_width_audit", "WITH " + votes_cte("intent") + " SELECT 5 AS width, count(*) AS n, count(DISTINCT record_id) AS ids FROM vt")
def e20(spark, sf):
    v, _ = _votes(spark, sf, "intent")
    return v.groupBy(F.size("votes").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("ids"))


_FIT = "('0x' || substr(sha256(concat_ws(chr(1), 'h6', record_id::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0 < 0.7"


@query("h06_train_only_fit", "WITH " + em_cte("sensitivity", 3, base=votes_cte("sensitivity").rpartition("FROM ev)")[0] + "FROM ev WHERE " + _FIT + ")") + " SELECT " + ", ".join(f"round(t{j}, 7) AS t{j}" for j in range(7)) + " FROM th")
def h06(spark, sf):
    v, m = _votes(spark, sf, "sensitivity")
    _, fit = labelmodel.fit(corpus.group_split(v, "record_id", None, "h6", {"train": 0.7, "validation": 0.15, "test": 0.15}).where("split = 'train'"), "votes", m, 3)
    return v.limit(1).select(*[F.lit(round(t, 7)).alias(f"t{j}") for j, t in enumerate(fit["theta"])])


_BEST5 = lambda p: "CASE " + " ".join("WHEN " + " AND ".join(f"{p}{k} >= {p}{o}" for o in range(5) if o != k) + f" THEN {k}" for k in range(5)) + " END"


@query("h07_suppressed_classes", "WITH " + em_cte("intent", 5) + ", c AS (SELECT post.*, " + ", ".join(f"(len(list_filter([v0, v1, v2, v3, v4], lambda x: x = {k})))::DOUBLE AS c{k}" for k in range(5)) + f" FROM post) SELECT DISTINCT {_BEST5('c')} AS class FROM c WHERE {_BEST5('c')} NOT IN (SELECT {_BEST5('p')} FROM c)")
def h07(spark, sf):
    v, m = _votes(spark, sf, "intent")
    patterns, _ = labelmodel.fit(v, "votes", m, 5)
    both = labelmodel.apply(v, "votes", patterns).withColumn("majority", labeling.majority(F.col("votes"), 5))
    return labelmodel.suppressed_classes(both, "majority", "probabilities")


@query("h08_unanimous_fallback", "WITH " + votes_cte("intent") + " SELECT record_id, CASE WHEN len(k) = 1 AND k[1] = 4 THEN 1.0::DOUBLE ELSE 0.2 END AS p4 FROM (SELECT record_id, list_distinct(list_filter([v0, v1, v2, v3, v4], lambda x: x >= 0)) AS k FROM vt)")
def h08(spark, sf):
    v, _ = _votes(spark, sf, "intent")
    p = labeling.unanimous_fallback(F.col("votes"), F.array_repeat(F.lit(0.2), 5), [4], 5)
    return v.select("record_id", p[4].alias("p4"))


@query("h09_targets_and_masks", "WITH " + votes_cte("intent") + " SELECT record_id, (v0 >= 0 OR v1 >= 0 OR v2 >= 0 OR v3 >= 0 OR v4 >= 0)::INT AS observed FROM vt")
def h09(spark, sf):
    v, _ = _votes(spark, sf, "intent")
    observed = F.map_from_arrays(F.array(F.lit("intent")), F.array(F.exists("votes", lambda x: x >= 0).cast("int")))
    return v.withColumn("observed", observed).select("record_id", F.col("observed")["intent"].alias("observed"))


@query("h10_soft_label_classifier")
def h10(spark, sf):
    v, m = _votes(spark, sf, "sensitivity")
    patterns, _ = labelmodel.fit(v, "votes", m, 3)
    rows = labelmodel.apply(v, "votes", patterns).select("record_id", "probabilities").join(tq(spark, sf).select("record_id", "query_text"), "record_id")
    model = classifier.fit(rows, "query_text", "probabilities")
    got = model.transform(rows).withColumn("best", P.argmax(F.col("probabilities")))
    return got.agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("prediction").cast("int") == F.col("best")).cast("int")) > 0.8).alias("agrees"))


@query("j02_isolation", f"WITH {_SPLIT} SELECT 'text' AS kind, count(*) AS n FROM (SELECT lower(text) FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def j02(spark, sf):
    return groups.isolation_errors(split(spark, sf), {"text": F.md5(F.lower("text"))}, "split").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("j03_natural_rows_only", f"WITH {_SPLIT} SELECT count(*) AS n FROM sp WHERE source = 'src3' AND split <> 'train'")
def j03(spark, sf):
    return split(spark, sf).where("source = 'src3' AND split <> 'train'").agg(F.count(F.lit(1)).alias("n"))


@query("j05_split_alignment", f"WITH {_SPLIT} SELECT split, count(*) AS n FROM sp JOIN labels USING (doc_id) GROUP BY split")
def j05(spark, sf):
    return split(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("k10_policy_grid", "SELECT c_custkey, 'eps' || e || '_cov' || c || '_types' || (row_number() OVER (PARTITION BY c_custkey ORDER BY e, c) - 1) AS policy_id FROM (VALUES (1), (2)) AS a(e), (VALUES ('0.5'), ('1')) AS b(c), customer")
def k10(spark, sf):
    #: each customer is a deployment with the whole grid
    grid = R.candidates(spark, [1.0, 2.0], [0.5, 1.0], [["*"]])
    return table(spark, sf, "customer").crossJoin(F.broadcast(grid)).select("c_custkey", "policy_id")


@query("k12_constraint_margins", f"WITH {_POL} SELECT record_id, policy_id, round(privacy - required, 9) AS privacy_margin, round(utility - 0.6, 9) AS utility_margin FROM rq, prof")
def k12(spark, sf):
    _, f = policies(spark)
    r = risks(spark, sf).withColumn("required", R.required_protection(F.col("score"), F.col("uncertainty"), F.col("ignorance"), 0.5))
    return r.crossJoin(F.broadcast(f)).select("record_id", "policy_id", F.round(F.col("privacy") - F.col("required"), 9).alias("privacy_margin"), F.round(F.col("utility") - 0.6, 9).alias("utility_margin"))


_CUE = lambda name: "regexp_matches(lower(query_text), '" + cues.CUES[name].replace("'", "''") + "')"
#: the identifying patterns, a word boundary or the text's start standing for what this dialect cannot look back at
_DIRECT = [evidence.OFFSET_PATTERNS[n].replace(r"(?<!\w)", r"(?:^|\W)").replace("'", "''") for n in ("email", "phone", "identifier", "credential")]
_CUES = CL + ", q0 AS (SELECT record_id, " + ", ".join(f"{_CUE(n)} AS {n}" for n in cues.CUES) + ", " + " OR ".join(f"regexp_matches(query_text, '(?i){p}')" for p in _DIRECT) + """ AS direct FROM cl),
q1 AS (SELECT *, personal AND medical_sensitive AS med, personal AND financial_artifact AS fin, reid_words AND (subject_words OR direct OR record_words) AS who,
  attr_words AND subject_words AND attr_targets AS trait, subject_words AND set_words AND member_words AS presence,
  request AND secret_words AND (subject_words OR personal OR records_word) AS secret FROM q0),
q2 AS (SELECT *, personal OR direct OR who OR trait OR presence OR secret AS people FROM q1),
q3 AS (SELECT *, general_form AND NOT people AS plain, (general_form OR aggregate_words) AND NOT people AS harmless,
  personal AND (medical_topic OR finance_topic OR limited_words) AND NOT (med OR fin OR direct OR secret) AS light FROM q2)"""
_V = lambda when, k, name: f"CASE WHEN {when} THEN {k} ELSE -1 END AS {name}"


def cued(spark, sf):
    c = corpus.clean_records(tq(spark, sf), nfkc=False)
    return cues.add_cues(c, patterns=F.transform(evidence.offset_matches("query_text"), lambda m: m["name"]))


@query("b15_query_cues", f"WITH {_CUES} SELECT record_id, {', '.join(cues.CUES)}, direct, subject_words AS subject, who AS reid, trait AS attr, presence AS member, med, fin, secret AS confidential, people AS private, plain AS general, harmless AS explicit_benign, light AS limited FROM q3")
def b15(spark, sf):
    names = [*cues.CUES, "direct", *cues.SIGNALS]
    return cued(spark, sf).select("record_id", *[F.col(f"cue_{n}").alias(n) for n in names])


@query("c11_cue_sensitivity", f"WITH {_CUES} SELECT record_id, {_V('plain', 0, 'explicit_general_information')}, {_V('light', 1, 'limited_private_topic')}, {_V('med', 2, 'personal_medical')}, {_V('fin', 2, 'personal_finance')}, {_V('direct', 2, 'direct_structured_identifier')}, {_V('secret OR who OR trait OR presence OR data', 2, 'confidential_request')} FROM q3")
def c11(spark, sf):
    return cued(spark, sf).select("record_id", *[v.alias(n) for n, v in cues.cue_votes("sensitivity").items()])


@query("c12_cue_intent", f"WITH {_CUES} SELECT record_id, {_V('plain', 0, 'general_request')}, {_V('request AND data AND NOT med AND NOT fin', 1, 'personal_data_request')}, {_V('secret AND NOT who', 1, 'confidential_personal_request')}, {_V('request AND med', 2, 'personal_medical_request')}, {_V('request AND fin', 3, 'personal_financial_request')}, {_V('who', 4, 'identity_request')} FROM q3")
def c12(spark, sf):
    return cued(spark, sf).select("record_id", *[v.alias(n) for n, v in cues.cue_votes("privacy_relevant_intent").items()])


_THREATS = {"re_identification": "who", "attribute_inference": "trait", "membership_inference": "presence"}


@query("c13_cue_threats", f"WITH {_CUES} SELECT record_id, {', '.join(_V(f, 1, f'{t}_semantic_request') + ', ' + _V('harmless', 0, f'{t}_explicit_benign_information') + ', ' + _V('preserving AND NOT who AND NOT trait AND NOT presence', 0, f'{t}_explicit_privacy_preserving_request') for t, f in _THREATS.items())} FROM q3")
def c13(spark, sf):
    return cued(spark, sf).select("record_id", *[v.alias(f"{t}_{n}") for t in _THREATS for n, v in cues.cue_votes(f"threat_{t}").items()])


#: Offset patterns for a dialect without look-around and with ASCII words: letters beyond ASCII become ``_`` first, which is as much
#: of a word and in no class of letters; a phone's first group is what must come before it.
_BEYOND = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{373}\x{376}-\x{377}\x{37B}-\x{37D}\x{386}\x{388}-\x{481}\x{48A}-\x{559}\x{5D0}-\x{5EA}\x{620}-\x{64A}\x{904}-\x{939}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"
_OFFSETS = "o0 AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '" + _BEYOND + "', '_', 'g') AS t FROM documents), " + "om AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS name, regexp_extract_all(t, {q}) AS m, string_split_regex(t, {q}) AS gaps, {'regexp_extract_all(t, ' + q + ', 1)' if n == 'phone' else '[]::VARCHAR[]'} AS lead FROM o0"
    for n, q in ((n, "'(?i)" + p.replace("'", "''").replace(r"(?<!\w)", r"(^|\W)") + "'") for n, p in evidence.OFFSET_PATTERNS.items())
) + """), ou AS (SELECT doc_id, name, m, gaps, coalesce(length(lead[i]), 0) AS skip, i FROM om, unnest(generate_series(1, len(m))) AS g(i)),
of AS (SELECT doc_id, name, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + skip)::INT AS start, length(m[i]) - skip AS size FROM ou)"""


@query("b08_offset_evidence", f'WITH {_OFFSETS} SELECT doc_id, name, start, (start + size)::INT AS "end" FROM of')
def b08(spark, sf):
    m = docs(spark, sf).select("doc_id", F.explode(evidence.offset_matches("text")).alias("m"))
    return m.select("doc_id", "m.name", "m.start", "m.end")


@query("b09_span_baseline")
def b09(spark, sf):
    s = evidence.baseline_spans(evidence.offset_matches("text"), {"email": "EMAIL", "phone": "PHONE_NUMBER"})
    return docs(spark, sf).select("doc_id", s.alias("spans")).where(F.size("spans") > 0)


@query("b09_baseline_rows", f"WITH {_OFFSETS} SELECT doc_id, start, (start + size)::INT AS \"end\", CASE name WHEN 'email' THEN 'EMAIL' ELSE 'PHONE_NUMBER' END AS type, 1.0::DOUBLE AS confidence FROM of WHERE name IN ('email', 'phone')")
def b09_rows(spark, sf):
    return b09(spark, sf).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


@query("b16_token_offsets", r"SELECT doc_id, CASE WHEN text IS NOT NULL THEN len(regexp_extract_all(text, '[^\s\x0B]+')) END::INT AS n, NULL AS error FROM documents")
def b16(spark, sf):
    d = docs(spark, sf).select("doc_id", F.filter(F.split("text", r"[\s]+"), lambda w: w != "").alias("tokens"), "text")
    return d.select("doc_id", spans.token_offsets("tokens", "text").alias("o")).select("doc_id", F.size("o.starts").alias("n"), "o.error")


@query("b20_lossless_tokens", "SELECT doc_id, len(string_split(coalesce(text, ''), ' ')) AS n, true AS same FROM documents")
def b20(spark, sf):
    d = docs(spark, sf).withColumn("w", F.split(F.coalesce("text", F.lit("")), " ", -1))
    d = d.withColumn("b", F.transform("w", lambda x, i: i < F.size("w") - 1))
    return d.select("doc_id", F.size("w").alias("n"), (spans.rebuilt_text(F.col("w"), F.col("b")) == F.coalesce("text", F.lit(""))).alias("same"))


@query("b33_record_inspection", "WITH " + em_cte("sensitivity", 3) + " SELECT record_id, round(p0, 7) AS low, round(p1, 7) AS medium, round(p2, 7) AS high FROM vt JOIN post ON " + " AND ".join(f"vt.v{j} = post.v{j}" for j in range(7)))
def b33(spark, sf):
    v, m = _votes(spark, sf, "sensitivity")
    patterns, _ = labelmodel.fit(v, "votes", m, 3)
    names = labeling.TAXONOMY["sensitivity"]
    got = labelmodel.apply(v, "votes", patterns).withColumn("by", F.map_from_arrays(F.array(*map(F.lit, names)), "probabilities"))
    return got.select("record_id", *[F.round(F.col("by")[n], 7).alias(n) for n in names])


_ATT = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"


@query("i07_attack_robustness", f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_ATT}')) AS v FROM documents), a AS (SELECT 'email_obfuscation' AS attack, replace(replace(v, '@', ' [at] '), '.', ' [dot] ') AS w, v FROM m UNION ALL SELECT 'character_substitution', translate(v, 'aeo', 'аео'), v FROM m) SELECT attack, count(*) FILTER (WHERE w <> v) AS changed, count(*) FILTER (WHERE w <> v AND NOT regexp_full_match(w, '{_ATT}')) AS missed FROM a GROUP BY attack")
def i07(spark, sf):
    d = docs(spark, sf).where(F.col("text").rlike(_ATT)).select("doc_id", "text", spans.pattern_spans(F.col("text"), _ATT, "EMAIL").alias("spans"))
    kinds = ("email_obfuscation", "character_substitution")
    r = spans.attack_records(d, "doc_id", "text", "spans", kinds)
    x = r.select("attack", "text", F.explode(F.arrays_zip("spans", "entity_changed")).alias("x"))
    w = F.substring(F.col("text"), F.col("x.spans.start") + 1, F.col("x.spans.end") - F.col("x.spans.start"))
    changed = F.col("x.entity_changed")
    n = x.groupBy("attack").agg(F.count_if(changed).alias("changed"), F.count_if(changed & ~w.rlike(f"^(?:{_ATT})$")).alias("missed"))
    #: one row an attack
    return spark.createDataFrame([(k,) for k in kinds], "attack string").join(F.broadcast(n), "attack", "left").fillna(0)


@query("i17_temperature_by_head", f"WITH {temperature_sql({'first': 0, 'second': 10})} SELECT head, round(exp(t), 2) AS temperature, round(nll, 6) AS nll, round((SELECT avg(ln(list_sum(list_transform(l, lambda x: exp(x - top)))) + top - y) FROM hy WHERE hy.head = b2.head), 6) AS nll_before FROM b2")
def i17(spark, sf):
    out = None
    for name, z in _heads(spark, sf, {"first": 0, "second": 10}):
        t = metrics.fit_temperature(z, "z", "y")
        scored = lambda t, c: metrics.token_scores(z.withColumn("p", P.softmax(F.col("z"), t)), "p", "y").select(F.round("nll", 6).alias(c))  # noqa: B023, E731
        d = scored(t, "nll").crossJoin(scored(1.0, "nll_before")).select(F.lit(name).alias("head"), F.lit(round(t, 2)).alias("temperature"), "nll", "nll_before")
        out = d if out is None else out.unionByName(d)
    return out


@query("i18_reliability_records", "WITH t AS (SELECT l_orderkey AS record, 0.5 + l_discount::DOUBLE * 4 AS c, l_tax::DOUBLE * 10 AS u FROM lineitem) SELECT record, round(min(c), 9) AS confidence, round(max(u), 9) AS uncertainty, count(*) AS n FROM t GROUP BY record")
def i18(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), (0.5 + F.col("l_discount").cast("double") * 4).alias("c"), (F.col("l_tax").cast("double") * 10).alias("u"))
    return l.groupBy("record").agg(F.round(F.min("c"), 9).alias("confidence"), F.round(F.max("u"), 9).alias("uncertainty"), F.count(F.lit(1)).alias("n"))


@query("i23_masked_agreement", "SELECT lang, count(quality) AS observed, round(avg((quality = toxic)::INT), 9) AS agreement FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def i23(spark, sf):
    j = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("quality").alias("observed"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 9).alias("agreement"))


@query("a03_nested_documents", "SELECT n_orders, count(*) AS n FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) JOIN orders USING (o_custkey) GROUP BY n_orders")
def a03(spark, sf):
    """A document for each customer, with a question for each order."""
    asked = F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_comment" if "o_comment" in table(spark, sf, "orders").columns else "o_orderpriority").alias("question")))
    nested = table(spark, sf, "orders").groupBy("o_custkey").agg(asked.alias("questions"))
    nested = nested.select(F.struct(F.col("o_custkey").cast("string").alias("uid"), F.array(F.array(F.lit("x"))).alias("table")).alias("table"), F.array(F.lit("p")).alias("paragraphs"), "questions")
    sizes = corpus.explode_documents(nested).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_orders"))
    return sizes.groupBy("n_orders").agg(F.sum("n_orders").alias("n"))
