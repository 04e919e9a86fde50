"""Queries over where records come from and whether they are what they were: sources, checksums, manifests, audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilmark.operators import corpus, groups, scenarios
from veilmark.plans.data import _SPLIT, docs, split
from veilmark.plans.fixtures import _quoted, table
from veilmark.plans.registry import query
from veilmark.scratch import checkpoint_dir, cut, drop
from veilmark.sources import manifest, readers


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# A-02: four shapes of source over one nested table

_PASSAGE = "array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, '. '))), ' ')"


def nested(spark, sf):
    """Documents as sources have them: (doc_id, input, instruction, output, question, answer, context array<struct<title, sentences>>)."""
    d = docs(spark, sf)
    lines = F.transform(F.split("text", "\n", -1), lambda l, i: F.struct(i.cast("string").alias("title"), F.split(l, r"\. ", -1).alias("sentences")))
    return d.select("doc_id", F.when(F.col("doc_id") % 8 == 0, "").otherwise(F.col("text")).alias("input"), F.col("lang").alias("instruction"), F.col("source").alias("output"), F.struct(F.struct(F.col("lang").alias("text")).alias("question")).alias("page"), lines.alias("context"))


@query("a02_nested_adapters", f"""WITH n AS (SELECT doc_id, doc_id % 4 AS k, CASE WHEN doc_id % 8 = 0 THEN '' ELSE text END AS input, lang, source, coalesce({_PASSAGE}, '') AS passage FROM documents)
SELECT doc_id, ['patients', 'passages', 'multi_hop', 'pages'][k + 1] AS source_dataset, md5(CASE k WHEN 0 THEN coalesce(nullif(input, ''), nullif(lang, ''), '') WHEN 1 THEN coalesce(input, '') ELSE coalesce(lang, '') END) AS query, md5(CASE k WHEN 0 THEN coalesce(source, '') WHEN 1 THEN coalesce(lang, '') WHEN 2 THEN coalesce(source, '') || ' ' || passage ELSE '' END) AS context FROM n""")
def a02_nested(spark, sf):
    n = nested(spark, sf)
    shapes = [("patients", ["input", "instruction"], ["output"]), ("passages", ["input"], ["instruction"]), ("multi_hop", ["page.question.text"], ["output", "context.sentences"]), ("pages", ["page.question.text"], [])]
    parts = [readers.adapt_nested(n.where(F.col("doc_id") % 4 == k), q, c, name, "any").select("doc_id", "source_dataset", F.md5("query_text").alias("query"), F.md5("context_text").alias("context")) for k, (name, q, c) in enumerate(shapes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# A-06, A-07: what is read when sources are missing or damaged


@query("a06_damaged_sources", "SELECT * FROM (SELECT 'damaged_local' AS case_name, 'real_cached' AS outcome, count(*) AS n FROM documents UNION ALL SELECT 'all_missing', 'synthetic_fallback', count(*) FROM nation UNION ALL SELECT 'no_fallback', 'refused', 0) t")
def a06_damaged(spark, sf):
    bad, good, none = (_folder(spark, n) for n in ("damaged", "cached", "missing"))
    d = docs(spark, sf).select("doc_id", "text")
    schema = "doc_id long, text string"
    # a line in the middle is cut off; the first rows can be read
    d.select(F.when(F.col("doc_id") == 7, F.lit('{"doc_id": 7, "te')).otherwise(F.to_json(F.struct("doc_id", "text"))).alias("value")).write.text(bad)
    d.write.json(good)
    synthetic = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("text"))
    got = readers.first_source(spark, [("real_local", bad), ("real_cached", good)], schema, whole=True).groupBy(F.lit("damaged_local").alias("case_name"), F.col("source_mode").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    none = readers.first_source(spark, [("real_local", none)], schema, synthetic).groupBy(F.lit("all_missing").alias("case_name"), F.col("source_mode").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    try:
        readers.first_source(spark, [("real_local", bad)], schema, whole=True)
        refused = "read"
    except FileNotFoundError:
        refused = "refused"
    last = spark.createDataFrame([("no_fallback", refused, 0)], "case_name string, outcome string, n long")
    out = cut(got.unionByName(none).unionByName(last))
    drop(spark, bad)
    drop(spark, good)
    return out


# A-10: files that are pinned


@query("a10_pinned_files", "SELECT lang AS name, CASE WHEN lang = (SELECT min(lang) FROM documents) THEN 'changed' ELSE 'ok' END AS status, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'nowhere', 'missing', 0")
def a10_pinned(spark, sf):
    """Files for each language, pinned by the digests of their bytes; then one language is written again with a row less."""
    root = _folder(spark, "pinned")
    d = docs(spark, sf).where("lang is not null").select(F.concat(F.lit("x"), F.hex("lang")).alias("name"), "doc_id", "text")
    # folders are named by code, as stores may not tell letters apart; each task writes its own rows of each language
    d.write.mode("overwrite").partitionBy("name").json(root)

    def digests():
        """(name, digest): of each language the files' digests in order, few however large the files are."""
        files = readers.file_digests(spark, root).select(F.regexp_extract("path", "/name=(x[0-9A-F]*)/", 1).alias("name"), "sha256")
        return files.groupBy("name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("digest"))

    pins = cut(digests())
    first = d.agg(F.min("name")).first()[0]
    here = d.where(F.col("name") == first)
    again = f"{root}/name={first}"
    here.where(F.col("doc_id") > here.agg(F.min("doc_id")).first()[0]).select("doc_id", "text").write.mode("overwrite").json(again)
    rows = pins.join(digests().withColumnRenamed("digest", "now").hint("merge"), "name", "left").select(F.decode(F.unhex(F.substring("name", 2, 1 << 20)), "UTF-8").alias("name"), F.when(F.col("digest").eqNullSafe(F.col("now")), "ok").otherwise("changed").alias("status"))
    missing = readers.file_checks(spark, again, {"nowhere": "0"}).select("name", "status")
    counts = docs(spark, sf).groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    out = cut(rows.unionByName(missing).join(F.broadcast(counts), "name", "left").select("name", "status", F.coalesce("n", F.lit(0).cast("long")).alias("n")))
    drop(spark, root)
    return out


# A-12: scenarios

TRAIN = scenarios.Partition("train", [("t1", "health", "After {ailment} my report in the {folder} names me, who reads it? {marker}"), ("t2", "money", "Does a late {bill} show up in the {folder}? {marker}"), ("t3", "plain", "Explain how a {folder} is kept."), ("t4", "plain", "Is a {bill} the same as {ailment}?")], {"ailment": ["asthma", "a sprain", "migraine"], "bill": ["invoice", "mortgage rate"], "folder": ["archive", "ledger", "binder", "register", "dossier"]}, "TRN")
HELD = scenarios.Partition("heldout", [("h1", "health", "The clinic keeps notes on {ailment} in its {folder}; may I erase them? {marker}"), ("h2", "plain", "Describe a {folder} beside a {bill}.")], {"ailment": ["a rash", "vertigo"], "bill": ["receipt", "voucher", "fee"], "folder": ["drawer", "vault"]}, "HLD")
SCENARIO_LABELS = [("health", "high", 2), ("money", "medium", 2), ("plain", "low", 0)]


def generated(spark, sf):
    labels = spark.createDataFrame(SCENARIO_LABELS, "scenario string, sensitivity string, risk_tier int")
    numbers = table(spark, sf, "customer").select(F.col("c_custkey").alias("i"))
    scenarios.refuse_overlap(TRAIN, HELD)
    return scenarios.generate(numbers, TRAIN, labels).unionByName(scenarios.generate(numbers, HELD, labels))


def _generated_sql(part: scenarios.Partition, view: str) -> str:
    rows = ", ".join(f"({k}, {', '.join(map(_quoted, t))})" for k, t in enumerate(part.templates))
    text = "x"
    for slot, words in part.lexicon.items():
        text = f"replace({text}, '{{{slot}}}', [{', '.join(map(_quoted, words))}][((i // {len(part.templates)}) % {len(words)}) + 1])"
    text = f"replace({text}, '{{marker}}', '[{part.marker}_' || lpad(i::VARCHAR, greatest(5, length(i::VARCHAR))::INT, '0') || ']')"
    return f"{view}t(k, template_id, scenario, x) AS (VALUES {rows}), {view}r AS (SELECT i, template_id, scenario, {text} AS query_text FROM nr JOIN {view}t ON i % {len(part.templates)} = k), {view} AS (SELECT *, '{part.name}' AS partition FROM {view}r QUALIFY row_number() OVER (PARTITION BY query_text ORDER BY i) = 1)"


_GENERATED = f"nr AS (SELECT c_custkey AS i FROM customer), {_generated_sql(TRAIN, 'gt')}, {_generated_sql(HELD, 'gh')}, lb(scenario, sensitivity, risk_tier) AS (VALUES {', '.join(map(str, SCENARIO_LABELS))}), ge AS (SELECT * FROM (SELECT * FROM gt UNION ALL SELECT * FROM gh) LEFT JOIN lb USING (scenario))"


@query("a12_generated_scenarios", f"WITH {_GENERATED} SELECT partition, i::BIGINT AS i, template_id, scenario, query_text, sensitivity, risk_tier FROM ge")
def a12_generated(spark, sf):
    return generated(spark, sf).select("partition", "i", "template_id", "scenario", "query_text", "sensitivity", "risk_tier")


@query("a12_partitions_disjoint", f"WITH {_GENERATED} SELECT count(*) FILTER (WHERE n > 1) AS shared_texts, count(*) FILTER (WHERE n > 1 AND template) AS shared_templates, count(*) AS texts FROM (SELECT query_text, count(DISTINCT partition) AS n, false AS template FROM ge GROUP BY query_text UNION ALL SELECT x, count(DISTINCT p), true FROM (SELECT x, 1 AS p FROM gtt UNION ALL SELECT x, 2 FROM ght) GROUP BY x)")
def a12_disjoint(spark, sf):
    texts = generated(spark, sf).groupBy("query_text").agg(F.countDistinct("partition").alias("n")).withColumn("template", F.lit(False))
    known = spark.createDataFrame([(t[2], p.name) for p in (TRAIN, HELD) for t in p.templates], "query_text string, partition string")
    both = texts.unionByName(known.groupBy("query_text").agg(F.countDistinct("partition").alias("n")).withColumn("template", F.lit(True)))
    return both.agg(F.count_if(F.col("n") > 1).alias("shared_texts"), F.count_if((F.col("n") > 1) & F.col("template")).alias("shared_templates"), F.count(F.lit(1)).alias("texts"))


# A-16: a chain of stages


@query("a16_manifest_chain", "SELECT scenario, outcome, CASE WHEN outcome = 'verified' THEN n END AS n FROM (VALUES ('intact', 'verified'), ('other_config', 'refused: configuration'), ('other_ancestor_config', 'refused: configuration'), ('parent_rewritten', 'refused: written again'), ('made_again', 'verified'), ('ancestor_changed', 'refused: changed')) t(scenario, outcome), (SELECT count(*) AS n FROM documents WHERE length(text) >= 40)")
def a16_chain(spark, sf):
    """Raw, cleaned and short-listed documents as three stages, and what a check says after each kind of change."""
    root = _folder(spark, "stages")
    at, man = lambda s: f"{root}/{s}", f"{root}/manifest"
    raw = docs(spark, sf).select("doc_id", "text")
    made = {"raw": {"columns": 2}, "clean": {"trim": True}, "long": {"least": 40}}

    def write(stage: str) -> None:
        if stage == "raw":
            return manifest.write_stage(raw, at("raw"), man, "raw", made["raw"])
        if stage == "clean":
            return manifest.write_stage(spark.read.parquet(at("raw")).where("text is not null"), at("clean"), man, "clean", made["clean"], "raw")
        manifest.write_stage(spark.read.parquet(at("clean")).where("length(text) >= 40"), at("long"), man, "long", made["long"], "clean")

    def check(scenario: str, config: dict, configs: dict | None = None) -> tuple:
        try:
            return scenario, "verified", manifest.verify_stage(spark, man, "long", config, configs).count()
        except ValueError as e:
            kinds = {"configuration": "configuration", "written again": "written again", "has changed": "changed", "altered": "altered"}
            return scenario, "refused: " + next(v for k, v in kinds.items() if k in str(e)), None

    for stage in made:
        write(stage)
    rows = [check("intact", made["long"], made), check("other_config", {"least": 41}), check("other_ancestor_config", made["long"], {"raw": {"columns": 3}})]
    write("clean")
    rows.append(check("parent_rewritten", made["long"]))
    write("long")
    rows.append(check("made_again", made["long"], made))
    raw.where("doc_id <> 5").write.mode("overwrite").parquet(at("raw"))
    rows.append(check("ancestor_changed", made["long"]))
    drop(spark, root)
    return spark.createDataFrame(rows, "scenario string, outcome string, n long")


# J-01, J-04, J-11


@query("j01_leakage_examples", f"""WITH {_SPLIT}, k AS (SELECT 'text' AS kind, md5(lower(text)) AS key, split FROM sp UNION ALL SELECT 'id', doc_id::VARCHAR, split FROM sp UNION ALL SELECT 'source', source || (doc_id // 3)::VARCHAR, split FROM sp),
u AS (SELECT DISTINCT * FROM k WHERE key IS NOT NULL), p AS (SELECT a.kind, a.split AS split_a, b.split AS split_b, a.key FROM u a JOIN u b ON a.kind = b.kind AND a.key = b.key AND a.split < b.split)
SELECT kind, split_a, split_b, count(*) AS n, array_to_string(list_slice(list_sort(list(key)), 1, 5), ',') AS examples FROM p GROUP BY ALL""")
def j01_examples(spark, sf):
    keys = {"text": F.md5(F.lower("text")), "id": F.col("doc_id"), "source": F.concat("source", F.floor(F.col("doc_id") / 3).cast("string"))}
    return groups.leakage(split(spark, sf), keys, "split").withColumn("examples", F.array_join("examples", ","))


_CHECKS = """SELECT 'raw_equals_cleaned_plus_removed' AS check_name, (SELECT count(*) FROM documents) - (SELECT count(*) FROM documents WHERE text IS NULL OR length(text) < 20) AS expected, (SELECT count(*) FROM dd0) AS actual
UNION ALL SELECT 'cleaned_equals_unique_plus_duplicates', (SELECT count(*) FROM dd0), (SELECT count(*) FROM dd0)
UNION ALL SELECT 'splits_equal_unique', (SELECT count(*) FROM dd0 WHERE NOT is_duplicate), (SELECT count(*) FROM ss)
UNION ALL SELECT split || '_domains_equal_total', count(*), count(domain) FROM ss GROUP BY split"""


@query("j04_checks", f"""WITH dd0 AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lower(text) ORDER BY source, doc_id) > 1 AS is_duplicate FROM documents WHERE length(text) >= 20),
ss AS (SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split, CASE WHEN doc_id % 50 = 8 THEN NULL ELSE lang END AS domain FROM dd0 WHERE NOT is_duplicate AND doc_id % 100 <> 3),
c AS ({_CHECKS}) SELECT check_name, expected::BIGINT AS expected, actual::BIGINT AS actual, expected = actual AS ok FROM c""")
def j04_checks(spark, sf):
    """Splits that lose a row in a hundred, and test rows without a domain: two checks fail."""
    raw = docs(spark, sf)
    short = F.col("text").isNull() | (F.length("text") < 20)
    cleaned = raw.where(~short)
    removed = raw.where(short).count()
    marked = cut(corpus.dedup_flag(cleaned, F.lower("text"), [F.col("source"), F.col("doc_id")]).select("doc_id", "lang", "is_duplicate"))
    name = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "validation").otherwise("test")
    lossy = marked.where("not is_duplicate and doc_id % 100 <> 3").select(name.alias("split"), F.when(F.col("doc_id") % 50 != 8, F.col("lang")).alias("domain"))
    return groups.reconcile(raw, cleaned, removed, marked, lossy, "domain").withColumnRenamed("check", "check_name")


_PRINT = "md5(concat_ws(chr(1), " + ", ".join(f"coalesce({c}::VARCHAR, '∅')" for c in ("doc_id", "lang", "n_chars", "source", "split", "text")) + "))"


@query("j11_source_fingerprints", f"""WITH {_SPLIT}, f AS (SELECT source, split, ('0x' || substr({_PRINT.replace('n_chars', 'length(text)')}, 1, 15))::BIGINT AS h FROM sp)
SELECT source, count(*) AS rows, 150::BIGINT AS budget, count(*) > 150 AS over_budget, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) || ':' || sum(h) || ':' || bit_xor(h) AS fingerprint FROM f GROUP BY source""")
def j11_fingerprints(spark, sf):
    d = split(spark, sf).select("doc_id", "lang", F.length("text").alias("n_chars"), "source", "split", "text")
    return groups.source_audit(d, "source", "split", 150)



# E-20, J-09, M-01


@query("e20_alignment", f"""WITH {_SPLIT}, lb AS (SELECT CASE WHEN doc_id % 50 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS record_id, 'quality' AS dimension, 2 AS width FROM labels WHERE quality IS NOT NULL
  UNION ALL SELECT doc_id, 'toxic', CASE WHEN doc_id % 97 = 0 THEN 3 ELSE 2 END FROM labels WHERE toxic IS NOT NULL),
j AS (SELECT lb.*, split FROM lb LEFT JOIN (SELECT DISTINCT doc_id, split FROM sp) s ON s.doc_id = record_id)
SELECT dimension, count(*) AS rows, min(width) AS least_width, max(width) AS greatest_width, min(width) = 2 AND max(width) = 2 AS width_ok, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation,
  count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE split IS NULL) AS unknown, (SELECT count(DISTINCT doc_id) FROM sp WHERE split = 'train') - count(DISTINCT record_id) FILTER (WHERE split = 'train') AS missing FROM j GROUP BY dimension""")
def e20_alignment(spark, sf):
    """Labels of which some have lost their record, and some vectors are too wide."""
    l = table(spark, sf, "labels")
    one = lambda c: F.array((1 - F.col(c)).cast("double"), F.col(c).cast("double"))
    quality = l.where("quality is not null").select(F.when(F.col("doc_id") % 50 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("record_id"), F.lit("quality").alias("dimension"), one("quality").alias("probabilities"))
    toxic = l.where("toxic is not null").select(F.col("doc_id").alias("record_id"), F.lit("toxic").alias("dimension"), F.when(F.col("doc_id") % 97 == 0, F.concat(one("toxic"), F.array(F.lit(0.0)))).otherwise(one("toxic")).alias("probabilities"))
    return groups.alignment_audit(quality.unionByName(toxic), split(spark, sf).select(F.col("doc_id").alias("record_id"), "split"), {"quality": 2, "toxic": 2})


@query("j09_sealed_split", f"WITH {_SPLIT} SELECT 'development' AS job, 'allowed' AS outcome, count(*) AS n FROM sp WHERE split <> 'test' UNION ALL SELECT 'with_test_rows', 'refused', NULL UNION ALL SELECT 'final_evaluation', 'allowed', count(*) FROM sp WHERE split = 'test'")
def j09_sealed(spark, sf):
    s = cut(split(spark, sf).select("doc_id", "split"))
    rows = []
    for job, df, sealed in (("development", s.where("split <> 'test'"), "test"), ("with_test_rows", s, "test"), ("final_evaluation", s.where("split = 'test'"), "train")):
        try:
            rows.append((job, "allowed", manifest.refuse_sealed(df, sealed=sealed).count()))
        except ValueError:
            rows.append((job, "refused", None))
    return spark.createDataFrame(rows, "job string, outcome string, n long")


@query("m01_user_function", "SELECT doc_id, CASE WHEN text IS NULL THEN -1 WHEN contains(text, '@') THEN 1 WHEN length(text) < 200 THEN 0 ELSE -1 END AS has_address, -1 AS out_of_range FROM documents")
def m01_user(spark, sf):
    """A user's function is a Column with a name; votes out of range abstain."""
    from veilmark.operators.labeling import guarded

    mine = {"has_address": F.when(F.contains("text", F.lit("@")), 1).when(F.length("text") < 200, 0), "out_of_range": F.lit(7)}
    return docs(spark, sf).select("doc_id", *[guarded(v, 2).alias(n) for n, v in mine.items()])
