"""One query for each operator, over its whole table with production parameters, and its DuckDB SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import bpe, conversation_repair, embedding_dedup, exact_dedup, line_dedup, mixing, nearest_vectors, ngram_join, periodic_runs, sharding, substring_dedup, toxicity, warc

BPE_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), payload="digest", min_bytes=0)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.coalesce("payload_digest", "header_digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shards(_table(spark, sf_dir, "documents"), 16, "bytes")
    return done.withColumn("grown_shard", F.lit(None).cast("int"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max").withColumnRenamed("id", "doc_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, BPE_FILE, public_tokenizers.PATTERN).drop("ids")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"), words_in_gram=5, percent=75)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as op11's contract damages them: in one of ten texts the words from one on repeat a few before."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.withColumn("_w", F.when(h % 10 == 0, words))
    g, n = F.floor(h / 10), F.size("_w")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice("_w", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return split.withColumn("text", F.when(n > 0, F.array_join(F.concat(F.slice("_w", F.lit(1), a), tail), " ")).otherwise(F.col("text"))).drop("_w")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeat_tails(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    longest = -first["less"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), first["start"].alias("start"), longest.alias("length"), first["period"].alias("period"),
        F.floor(1000 * longest / first["period"]).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damage_turns(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations as op12's contract damages them, and how often each row is there: 0, 1 or 2 times."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    c = F.crc32(F.concat_ws(":", named("conv_id"), named("turn")).cast("binary")) % 20
    text = F.when(c == 1, "").when(c == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    rows = rows.select("conv_id", "turn", F.when(c == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), F.when(c == 0, 0).when(c == 3, 2).otherwise(1).alias("_times"))
    return rows, F.col("_times")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(*damage_turns(_table(spark, sf_dir, "conversations")))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_vectors.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_warc, op3_sharding, op4_exact_dedup, op5_mixing, op6_toxicity, op7_bpe, op8_ngram_join, op9_embedding_dedup, op10_substring_dedup, op11_periodic_runs, op12_conversation_repair, op13_nearest_vectors)}

#: CRC-32 of the text ``{x}``: a table ``t`` made by its polynomial, then one step for each character.
CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, generate_series(1, 8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))) AS v FROM range(256) AS r(i)))"""
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])), 4294967295)"

SQL = {
    "op1_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS g(i)
), k AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id""",
    "op2_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS hex FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h""",
    "op4_exact_dedup": r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce('s' || source, 'n') AS s FROM documents
), c AS (SELECT *, length(bin(size)) AS class FROM d),
z AS (SELECT s, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM c GROUP BY s),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM z),
w AS (SELECT *, 1 + (rank - 1) % 3 AS weight, 3 * source_size AS cap FROM r),
o AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (SELECT *, (SELECT level FROM o WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1) AS set FROM o),
t AS (SELECT s, source_size, CASE WHEN set IS NULL OR set * weight > cap THEN cap::DOUBLE ELSE set * weight END AS target FROM e),
p AS (SELECT c.*, row_number() OVER (PARTITION BY s ORDER BY class, size, doc_id) AS place FROM c),
u AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('start 1|' || s), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS start FROM p JOIN t USING (s))
SELECT doc_id, size, source_size, target, (size * least(floor(rate * place + start) - floor(rate * (place - 1) + start), 3))::BIGINT AS taken FROM u""",
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS gram
  FROM w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
h AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM h JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node WHERE r.least < e.b),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS least FROM v UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.node WHERE r.least < l.b),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op11_periodic_runs": "WITH " + CRC_TABLE + r""",
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, """ + CRC.format(x="doc_id::VARCHAR") + r""" AS h FROM documents, crc),
a AS (SELECT *, (h // 10) % greatest(len(w), 1) AS a FROM d),
p AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(generate_series(0, len(w) - 1), lambda i: w[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END]) ELSE w END AS w FROM p),
g AS (SELECT doc_id, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5]) AS g FROM w, unnest(generate_series(0, len(w) - 5)) AS s(i)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
c AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM s GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM c WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS x,
  sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest FROM r GROUP BY doc_id),
o AS (SELECT doc_id, list(DISTINCT i) AS gone FROM r, unnest(generate_series(start + period, start + length - 1)) AS t(i) GROUP BY doc_id),
k AS (SELECT w.doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept FROM w LEFT JOIN o ON o.doc_id = w.doc_id, unnest(generate_series(1, len(w))) AS t(i)
  WHERE gone IS NULL OR NOT list_contains(gone, i - 1) GROUP BY w.doc_id)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, x.start::BIGINT AS start, x.length::BIGINT AS length, x.period::BIGINT AS period, (1000 * x.length // x.period)::BIGINT AS exponent_milli,
  coalesce(digest, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op12_conversation_repair": "WITH RECURSIVE " + CRC_TABLE + r""",
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, """ + CRC.format(x="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))") + r""" % 20 AS c FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM o, unnest(generate_series(1, CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(k)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM p),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM n),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
  count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, list({'initial': initial, 'role': role, 'text': text, 'fault': fault} ORDER BY i) AS rows FROM f GROUP BY conv_id),
big AS (SELECT {'c': 1000000000, 'a': '', 't': ''} AS big),
s AS (
  SELECT conv_id, 0 AS i, rows, big, {'c': 0, 'a': '', 't': ''} AS v0, big AS v1, big AS v2, big AS v3 FROM q, big
  UNION ALL
  SELECT conv_id, i + 1, rows, big, {'c': w0.c + 3, 'a': w0.a || 'D', 't': w0.t},
    least({'c': v1.c + 3, 'a': v1.a || 'D', 't': v1.t}, CASE WHEN x.initial = 's' AND x.fault IN (0, 3) THEN {'c': w0.c + e, 'a': w0.a || 'K', 't': w0.t || said} ELSE big END),
    least({'c': w2.c + 3, 'a': w2.a || 'D', 't': w2.t},
      CASE WHEN x.initial = 'u' AND x.fault IN (0, 3) THEN least({'c': w0.c + e, 'a': w0.a || 'K', 't': w0.t || said}, {'c': v1.c + e, 'a': v1.a || 'K', 't': v1.t || said}, {'c': w3.c + e, 'a': w3.a || 'K', 't': w3.t || said}) ELSE big END,
      CASE WHEN x.fault IN (0, 3) THEN least({'c': w0.c + e + 2, 'a': w0.a || 'R', 't': w0.t || asu}, {'c': v1.c + e + 2, 'a': v1.a || 'R', 't': v1.t || asu}, {'c': w3.c + e + 2, 'a': w3.a || 'R', 't': w3.t || asu}) ELSE big END),
    least({'c': w3.c + 3, 'a': w3.a || 'D', 't': w3.t}, CASE WHEN x.initial = 'a' AND x.fault IN (0, 3) THEN {'c': w2.c + e, 'a': w2.a || 'K', 't': w2.t || said} ELSE big END,
      CASE WHEN x.fault IN (0, 3) THEN {'c': w2.c + e + 2, 'a': w2.a || 'R', 't': w2.t || asa} ELSE big END)
  FROM (SELECT *, v0 AS w0, least(v3, {'c': w2.c + 2, 'a': w2.a || 'I', 't': w2.t || chr(10) || 'assistant:'}) AS w3, (x.fault = 3)::INT AS e,
      chr(10) || x.role || ':' || x.text AS said, chr(10) || 'user:' || x.text AS asu, chr(10) || 'assistant:' || x.text AS asa
    FROM (SELECT *, rows[i + 1] AS x, least(v2, {'c': v0.c + 2, 'a': v0.a || 'I', 't': v0.t || chr(10) || 'user:'}, {'c': v1.c + 2, 'a': v1.a || 'I', 't': v1.t || chr(10) || 'user:'}, {'c': v3.c + 2, 'a': v3.a || 'I', 't': v3.t || chr(10) || 'user:'}) AS w2
      FROM s WHERE i < len(rows)))
), l AS (SELECT *, least(v2, {'c': v0.c + 2, 'a': v0.a || 'I', 't': v0.t || chr(10) || 'user:'}, {'c': v1.c + 2, 'a': v1.a || 'I', 't': v1.t || chr(10) || 'user:'}) AS w2 FROM s WHERE i = len(rows)),
z AS (SELECT conv_id, least(v0, v3, {'c': w2.c + 2, 'a': w2.a || 'I', 't': w2.t || chr(10) || 'assistant:'}) AS z FROM l)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(substr(z.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_nearest_vectors": r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(c.x, c.x))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM w, unnest(generate_series(1, len(w) - 34)) AS g(i)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, i + o AS i FROM f, unnest(generate_series(0, 34)) AS g(o)),
t AS (SELECT doc_id, i, w[i] AS word FROM w, unnest(generate_series(1, len(w))) AS g(i)),
k AS (SELECT t.doc_id, count(*) FILTER (WHERE x.i IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY t.i) FILTER (WHERE x.i IS NULL) AS kept
  FROM t LEFT JOIN x ON x.doc_id = t.doc_id AND x.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
