"""Queries over records and splits: sources, dedup, samples, splits, groups and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.functions.text import stable_id
from veilmark.operators import corpus, groups
from veilmark.plans.fixtures import CL, EV, TQ, records, table, tq
from veilmark.plans.registry import query
from veilmark.sources import manifest

_ID = "sha256(concat_ws(chr(1), {}))"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("a02_adapters", "SELECT 'documents' AS source_dataset, lang AS domain, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY lang UNION ALL SELECT 'benchmark', 'en', count(*), sum(length(coalesce(text, '')))::BIGINT FROM benchmark")
def a02_adapters(spark, sf):
    d = docs(spark, sf)
    a = d.select(F.coalesce("text", F.lit("")).alias("query_text"), F.lit("").alias("context_text"), F.lit("documents").alias("source_dataset"), F.col("lang").alias("domain"))
    b = corpus.adapt(table(spark, sf, "benchmark"), corpus.or_else("text"), F.lit(""), "benchmark", "en")
    return a.unionByName(b).groupBy("source_dataset", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("query_text")).alias("chars"))


@query("a04_harmonise", f"WITH {TQ} SELECT domain, count(*) AS n, count(DISTINCT {_ID.format('domain, query_text, context_text')}) AS ids FROM tq GROUP BY domain")
def a04_harmonise(spark, sf):
    t = tq(spark, sf)
    parts = [t.where(F.col("domain") == d).select("query_text", "context_text", F.col("domain").alias("source_dataset"), "domain") for d in ("medical", "financial", "multi_hop_qa", "general_qa")]
    return corpus.harmonise(parts).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("ids"))


@query("a05_stable_id", f"SELECT doc_id, substr({_ID.format('source, lang, doc_id::VARCHAR')}, 1, 24) AS record_id FROM documents")
def a05_id(spark, sf):
    return docs(spark, sf).select("doc_id", stable_id("source", "lang", "doc_id", length=24).alias("record_id"))


@query("a08_source_cap", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def a08_cap(spark, sf):
    return corpus.cap_per_group(docs(spark, sf), "source", [F.col("doc_id")], 20).select("doc_id", "source")


@query("a09_hash_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws('|', 'seed7', lang, doc_id::VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 50")
def a09_sample(spark, sf):
    return corpus.hash_sample(docs(spark, sf), 50, "seed7", "doc_id", by="lang").select("doc_id", "lang")


@query("a11_template_rows", f"WITH {TQ} SELECT record_id, domain, md5(query_text) AS q FROM tq")
def a11_rows(spark, sf):
    return tq(spark, sf).select("record_id", "domain", F.md5("query_text").alias("q"))


@query("a12_scenarios", f"WITH {TQ}, f AS (SELECT query_text, min(record_id) AS record_id FROM tq GROUP BY query_text), s(domain, tier) AS (VALUES ('medical', 2), ('financial', 2), ('general_qa', 1)) SELECT f.record_id, tier FROM f JOIN tq ON tq.record_id = f.record_id JOIN s ON s.domain = tq.domain")
def a12_scenarios(spark, sf):
    first = groups.representatives(tq(spark, sf), F.col("query_text"), ["record_id"])
    tiers = spark.createDataFrame([("medical", 2), ("financial", 2), ("general_qa", 1)], "domain string, tier int")
    return first.join(F.broadcast(tiers), "domain").select("record_id", "tier")


@query("a13_manual_rows", f"WITH {TQ}, u AS (SELECT domain FROM tq UNION ALL SELECT 'custom' FROM nation) SELECT domain, count(*) AS n FROM u GROUP BY domain")
def a13_manual(spark, sf):
    manual = table(spark, sf, "nation").select(F.lit("custom").alias("domain"), F.col("n_name").alias("query_text"))
    return tq(spark, sf).select("domain", "query_text").unionByName(manual).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("a16_fingerprint", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents")
def a16_fingerprint(spark, sf):
    d = docs(spark, sf)
    same = manifest.fingerprint(d) == manifest.fingerprint(d.repartition(7))
    return d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids")).where(F.lit(same))


@query("a17_merge_partitions", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents")
def a17_merge(spark, sf):
    d = docs(spark, sf).select("doc_id", "source")
    merged = corpus.merge_first([d.where(F.col("doc_id") % 3 == i) for i in range(3)] + [d.where("doc_id < 100")], "doc_id")
    return merged.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"))


@query("a18_census", "SELECT coalesce(source, '(all)') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def a18_census(spark, sf):
    return docs(spark, sf).rollup("source").count().select(F.coalesce("source", F.lit("(all)")).alias("source"), F.col("count").alias("n"))


@query("a19_role_routing", "SELECT role, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY role")
def a19_roles(spark, sf):
    side = table(spark, sf, "conversations").withColumn("pii_gold", F.col("role") == "user")
    return side.where("not pii_gold").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


_DUP = "dd AS (SELECT doc_id, row_number() OVER (PARTITION BY lower(coalesce(text, '')) ORDER BY source, doc_id) > 1 AS is_duplicate FROM documents)"


def flagged(spark, sf):
    d = docs(spark, sf)
    return corpus.dedup_flag(d, F.lower(F.coalesce("text", F.lit(""))), [F.col("source"), F.col("doc_id")])


@query("f01_dedup_flags", f"WITH {_DUP} SELECT doc_id, is_duplicate FROM dd")
def f01_flags(spark, sf):
    return flagged(spark, sf).select("doc_id", "is_duplicate")


@query("f01_dedup_stats", f"WITH {_DUP} SELECT count(*) AS input, count(*) FILTER (WHERE NOT is_duplicate) AS unique_rows, count(*) FILTER (WHERE is_duplicate) AS removed, count(*) FILTER (WHERE is_duplicate) / count(*) AS ratio FROM dd")
def f01_stats(spark, sf):
    return corpus.dedup_stats(flagged(spark, sf))


_SPLIT = "sp AS (SELECT doc_id, lang, source, text, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws('|', 's1', doc_id::VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents))"


def split(spark, sf):
    return corpus.stratified_split(docs(spark, sf), "lang", "doc_id", "s1")


@query("f02_stratified_split", f"WITH {_SPLIT} SELECT doc_id, split FROM sp")
def f02_split(spark, sf):
    return split(spark, sf).select("doc_id", "split")


_U = "('0x' || substr(sha256(concat_ws(chr(1), 'g1', source || (doc_id // 3)::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0"


@query("f03_group_split", f"SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, {_U} AS u FROM documents)")
def f03_groups(spark, sf):
    d = docs(spark, sf).withColumn("group_id", F.concat("source", F.floor(F.col("doc_id") / 3).cast("string")))
    return corpus.group_split(d, "group_id", None, "g1", {"train": 0.7, "validation": 0.15, "test": 0.15}).select("doc_id", "split")


@query("f06_balanced_sample", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws('|', 'b1', doc_id::VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang FROM r WHERE r <= (SELECT min(n) FROM r)")
def f06_balanced(spark, sf):
    return corpus.balanced(docs(spark, sf), "lang", "b1", "doc_id").select("doc_id", "lang")


@query("f11_budget_prefix", "SELECT doc_id, spent FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS spent FROM documents) WHERE spent <= (SELECT sum(n_chars) * 3 // 10 FROM documents)")
def f11_budget(spark, sf):
    d = docs(spark, sf).select("doc_id", "n_chars")
    budget = (d.agg(F.sum("n_chars")).first()[0] or 0) * 3 // 10
    return corpus.budget_prefix(d, "doc_id", "n_chars", budget).select("doc_id", "spent")


@query("f11_anchored_prefix", "SELECT doc_id, spent FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY CASE WHEN lang = 'es' AND doc_id % 50 = 0 THEN 0 ELSE 1 END, doc_id)::BIGINT AS spent FROM documents) WHERE spent <= (SELECT sum(n_chars) // 2 FROM documents)")
def f11_anchored(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang", "n_chars")
    half = (d.agg(F.sum("n_chars")).first()[0] or 0) // 2
    return corpus.budget_prefix(d, "doc_id", "n_chars", half, (F.col("lang") == "es") & (F.col("doc_id") % 50 == 0)).select("doc_id", "spent")


@query("f12_nested_subsets", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN lang = 'es' AND doc_id < 200 THEN 0 ELSE 1 END, sha256(concat_ws('|', 'n1', doc_id::VARCHAR))) AS rank, count(*) OVER () AS n, count(*) FILTER (WHERE lang = 'es' AND doc_id < 200) OVER () AS a FROM documents) SELECT doc_id, f AS fraction, rank FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) AS t(f) WHERE rank <= greatest(a, ceil(n * f))")
def f12_nested(spark, sf):
    d = docs(spark, sf)
    return corpus.nested_subsets(d, "doc_id", "n1", [0.25, 0.5, 0.75, 1.0], (F.col("lang") == "es") & (F.col("doc_id") < 200))


@query("f13_per_domain_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws('|', 'i1', source, doc_id::VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 5")
def f13_sample(spark, sf):
    return corpus.hash_sample(docs(spark, sf), 5, "i1", "doc_id", by="source").select("doc_id", "source")


@query("f15_carve_out", f"WITH {_SPLIT}, v AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws('|', 'c1', doc_id::VARCHAR)), doc_id) AS r, count(*) OVER () AS n FROM sp WHERE split = 'validation') SELECT doc_id, CASE WHEN r <= least(2000, floor(n * 0.3)) THEN 'calibration' ELSE 'evaluation' END AS part FROM v")
def f15_carve(spark, sf):
    v = split(spark, sf).where("split = 'validation'").withColumn("d", F.sha2(F.concat_ws("|", F.lit("c1"), F.col("doc_id").cast("string")), 256))
    n = F.broadcast(v.agg(F.count(F.lit(1)).alias("n")))
    ranked = corpus.global_rank(v, ["d", "doc_id"]).join(n)
    return ranked.select("doc_id", F.when(F.col("rank") <= F.least(F.lit(2000), F.floor(F.col("n") * 0.3)), "calibration").otherwise("evaluation").alias("part"))


@query("f16_shortest", "SELECT lang, arg_min(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY lang")
def f16_shortest(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"))


@query("e03_split_statistics", f"WITH {_SPLIT} SELECT coalesce(lang, '(all)') AS lang, coalesce(split, '(all)') AS split, count(*) AS n FROM sp GROUP BY CUBE (lang, split)")
def e03_statistics(spark, sf):
    return split(spark, sf).cube("lang", "split").count().select(F.coalesce("lang", F.lit("(all)")).alias("lang"), F.coalesce("split", F.lit("(all)")).alias("split"), F.col("count").alias("n"))


@query("e19_length_percentiles", "SELECT quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.95) AS p95, quantile_cont(w, 0.99) AS p99, round(avg((w > 128)::INT), 9) AS over_128, round(avg((w > 256)::INT), 9) AS over_256 FROM (SELECT len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM documents)")
def e19_lengths(spark, sf):
    w = docs(spark, sf).select(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))
    share = lambda n: F.round(F.avg((F.col("w") > n).cast("int")), 9)
    return w.agg(F.percentile("w", F.lit(0.5)).alias("p50"), F.percentile("w", F.lit(0.95)).alias("p95"), F.percentile("w", F.lit(0.99)).alias("p99"), share(128).alias("over_128"), share(256).alias("over_256"))


_COMP = """e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.doc_id <> b.doc_id AND (lower(a.text) = lower(b.text) OR (a.source = b.source AND a.doc_id // 3 = b.doc_id // 3))),
r AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node WHERE r.least < e.b),
cc AS (SELECT node AS doc_id, min(least) AS component FROM r GROUP BY node)"""


def components(spark, sf):
    d = docs(spark, sf)
    return groups.key_components(d, "doc_id", [F.md5(F.lower("text")), F.concat_ws(":", "source", F.floor(F.col("doc_id") / 3).cast("string"))])


_SUMS = ", ".join(f"sum(('0x' || substr(sha256(doc_id::VARCHAR), {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))


@query("g01_components", f"WITH RECURSIVE {_COMP}, gi AS (SELECT component, sha256(concat_ws(',', count(*)::VARCHAR, {_SUMS})) AS group_id FROM cc GROUP BY component) SELECT doc_id, component, group_id FROM cc JOIN gi USING (component)")
def g01_components(spark, sf):
    return components(spark, sf)


@query("g02_quarantine", f"WITH RECURSIVE {_COMP}, {_SPLIT} SELECT component, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, 'component_spans_splits' AS reason FROM cc JOIN sp USING (doc_id) GROUP BY component HAVING count(DISTINCT split) > 1")
def g02_quarantine(spark, sf):
    return groups.quarantine(components(spark, sf).join(split(spark, sf).select("doc_id", "split"), "doc_id"), "component", "split")


@query("g03_equal_texts", "SELECT doc_id, retained_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(text)) AS retained_id FROM documents) WHERE doc_id <> retained_id")
def g03_equal(spark, sf):
    return groups.discard_equal_texts(docs(spark, sf), F.lower("text"), "doc_id")


@query("g04_representatives", f"WITH {TQ} SELECT min(record_id) AS record_id FROM tq GROUP BY lower(query_text)")
def g04_representatives(spark, sf):
    return groups.representatives(tq(spark, sf), F.lower("query_text"), ["record_id"]).select("record_id")


@query("g05_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def g05_top(spark, sf):
    return docs(spark, sf).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("g07_best_candidate", "SELECT source FROM (SELECT source, avg(n_chars) AS f1, max(n_chars) AS latency FROM documents GROUP BY source) ORDER BY round(f1, 6) DESC, latency, source LIMIT 1")
def g07_best(spark, sf):
    g = docs(spark, sf).groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("f1"), F.max("n_chars").alias("latency"))
    return g.agg(F.min_by("source", F.struct((-F.col("f1")).alias("f"), "latency", "source")).alias("source"))


@query("g08_set_operations", "SELECT 'union' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)")
def g08_sets(spark, sf):
    a, b = docs(spark, sf).select("doc_id"), table(spark, sf, "labels").select("doc_id")
    parts = [d.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, d in (("union", a.unionByName(b)), ("intersect", a.intersect(b)), ("except", a.exceptAll(b)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("g09_augment", f"WITH {_SPLIT}, t AS (SELECT doc_id, text FROM sp WHERE split = 'train'), g AS (SELECT doc_id, text FROM sp WHERE split = 'test'), f AS (SELECT doc_id FROM g WHERE text NOT IN (SELECT text FROM t) ORDER BY doc_id LIMIT (SELECT least(50, floor(count(*) * 0.05))::BIGINT FROM t)) SELECT doc_id FROM t UNION ALL SELECT doc_id FROM f")
def g09_augment(spark, sf):
    s = split(spark, sf)
    pick = lambda name: s.where(F.col("split") == name).select("doc_id", "text")
    return groups.augment(pick("train"), pick("test"), "text", "doc_id", 50, 0.05).select("doc_id")


@query("g10_disjoint_templates", "SELECT count(*) AS shared FROM (SELECT text FROM benchmark INTERSECT SELECT text FROM documents)")
def g10_disjoint(spark, sf):
    return table(spark, sf, "benchmark").select("text").intersect(docs(spark, sf).select("text")).agg(F.count(F.lit(1)).alias("shared"))


@query("d02_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def d02_anti(spark, sf):
    return docs(spark, sf).select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("d03_default_lookup", "SELECT d.doc_id, coalesce(l.quality::VARCHAR, 'unknown') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def d03_lookup(spark, sf):
    j = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality"))


@query("d12_key_overlap", f"WITH {_SPLIT}, k AS (SELECT DISTINCT lower(text) AS k, split FROM sp) SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM k a JOIN k b ON a.k = b.k AND a.split < b.split GROUP BY ALL")
def d12_overlap(spark, sf):
    return groups.key_overlap(split(spark, sf), F.md5(F.lower("text")), "split")


@query("d13_collisions", "SELECT count(*) AS n FROM documents WHERE lower(text) IN (SELECT lower(text) FROM documents WHERE doc_id % 2 = 0) AND doc_id % 2 = 1")
def d13_collisions(spark, sf):
    d = docs(spark, sf).withColumn("k", F.md5(F.lower("text")))
    return d.where("doc_id % 2 = 1").join(d.where("doc_id % 2 = 0").select("k"), "k", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("j01_leakage", f"WITH {_SPLIT}, k AS (SELECT 'text' AS kind, lower(text) AS key, split FROM sp UNION ALL SELECT 'id', doc_id::VARCHAR, split FROM sp UNION ALL SELECT 'source', source || (doc_id // 3)::VARCHAR, split FROM sp) SELECT kind, count(*) AS n FROM (SELECT kind, key FROM k GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY kind")
def j01_leakage(spark, sf):
    keys = {"text": F.md5(F.lower("text")), "id": F.col("doc_id"), "source": F.concat("source", F.floor(F.col("doc_id") / 3).cast("string"))}
    return groups.isolation_errors(split(spark, sf), keys, "split").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("j04_reconciliation", f"WITH {_DUP} SELECT 'raw' AS check_name, count(*) AS n FROM dd UNION ALL SELECT 'deduped', count(*) FILTER (WHERE NOT is_duplicate) FROM dd UNION ALL SELECT 'removed', count(*) FILTER (WHERE is_duplicate) FROM dd")
def j04_reconciliation(spark, sf):
    s = corpus.dedup_stats(flagged(spark, sf))
    return s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(c).alias("n")) for k, c in (("raw", "input"), ("deduped", "unique_rows"), ("removed", "removed"))])).alias("x")).select("x.*")


@query("j06_coverage_gaps", f"WITH {_SPLIT} SELECT s.source, p.split FROM (SELECT DISTINCT source FROM sp WHERE lang = 'es') s, (SELECT DISTINCT split FROM sp) p WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.source = s.source AND sp.split = p.split AND lang = 'es')")
def j06_gaps(spark, sf):
    s = split(spark, sf)
    es = s.where("lang = 'es'")
    #: the splits are a few names
    grid = es.select("source").distinct().crossJoin(F.broadcast(s.select("split").distinct()))
    return grid.join(es.select("source", "split").distinct(), ["source", "split"], "left_anti")


@query("j07_repeats", "SELECT count(*) - count(DISTINCT doc_id) AS repeated_ids, count(*) - count(DISTINCT text) AS exact_excess, count(*) - count(DISTINCT lower(text)) AS normalised_excess FROM documents")
def j07_repeats(spark, sf):
    n = F.count(F.lit(1))
    return docs(spark, sf).agg((n - F.countDistinct("doc_id")).alias("repeated_ids"), (n - F.countDistinct("text")).alias("exact_excess"), (n - F.countDistinct(F.lower("text"))).alias("normalised_excess"))


@query("j08_label_closure", "SELECT p || '-' || t AS label FROM (SELECT DISTINCT l_returnflag AS t FROM lineitem), (VALUES ('B'), ('I')) AS x(p)")
def j08_closure(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag").distinct().select(F.explode(F.array(*[F.concat(F.lit(p), "l_returnflag") for p in ("B-", "I-")])).alias("label"))


@query("j11_source_audit", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def j11_audit(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"))


@query("j12_nested_check", "SELECT 0::BIGINT AS outside")
def j12_nested(spark, sf):
    n = corpus.nested_subsets(docs(spark, sf), "doc_id", "n1", [0.25, 0.5])
    small, large = n.where("fraction = 0.25").select("doc_id"), n.where("fraction = 0.5").select("doc_id")
    return small.join(large.hint("merge"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("outside"))


@query("b22_routing", f"WITH {CL} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN length(query_text) < 10 THEN 'short' WHEN context_text = '' THEN 'no_context' END AS reason FROM cl) GROUP BY ALL")
def b22_routing(spark, sf):
    from veilmark.operators.spans import route

    c = corpus.clean_records(tq(spark, sf), nfkc=False)
    ok, bad = route(c, F.when(F.length("query_text") < 10, "short").when(F.col("context_text") == "", "no_context"))
    return ok.withColumn("reason", F.lit("accepted")).unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("e13_contradictions", f"WITH {EV}, c AS (SELECT domain, 'contact_without_pattern' AS rule FROM ev WHERE contains(lt, 'mail') AND NOT h_email UNION ALL SELECT domain, 'account_without_number' FROM ev WHERE contains(lt, 'account') AND NOT h_account_number) SELECT domain, rule, count(*) AS n FROM c GROUP BY ALL")
def e13_contradictions(spark, sf):
    from veilmark.operators.evidence import hits

    t = F.lower("normalized_text")
    rules = F.array_compact(F.array(F.when(F.contains(t, F.lit("mail")) & ~hits("email"), "contact_without_pattern"), F.when(F.contains(t, F.lit("account")) & ~hits("account_number"), "account_without_number")))
    return records(spark, sf).select("domain", F.explode(rules).alias("rule")).groupBy("domain", "rule").agg(F.count(F.lit(1)).alias("n"))
