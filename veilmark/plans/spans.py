"""Queries over spans and tokens made from ``lineitem``, and over documents with patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.operators import spans as S
from veilmark.operators.groups import least_rows
from veilmark.plans.fixtures import table
from veilmark.plans.registry import query

_LI = "li AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag, l_quantity, l_discount) = 1), "
_GOLD = _LI + "gold AS (SELECT l_orderkey AS record, l_linenumber * 10 AS s, l_linenumber * 10 + 5 + l_partkey % 5 AS e, l_returnflag AS type, 's' || l_partkey % 5 AS source FROM li)"
_PRED = "pred AS (SELECT l_orderkey AS record, l_linenumber * 10 AS s, l_linenumber * 10 + 5 + l_partkey % 5 + (CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END) AS e, CASE WHEN l_suppkey % 13 = 0 THEN 'X' ELSE l_returnflag END AS type, 's' || l_partkey % 5 AS source FROM li WHERE l_suppkey % 7 <> 0)"
_BOTH = f"WITH {_GOLD}, {_PRED}"


def lines(spark, sf):
    """One row for each order and line number."""
    return least_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_discount"])


def gold(spark, sf, l=None):
    l = lines(spark, sf) if l is None else l
    return l.select(F.col("l_orderkey").alias("record"), (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + 5 + F.col("l_partkey") % 5).alias("e"), F.col("l_returnflag").alias("type"), F.concat(F.lit("s"), (F.col("l_partkey") % 5).cast("string")).alias("source"))


def predicted(spark, sf, l=None):
    l = (lines(spark, sf) if l is None else l).where("l_suppkey % 7 <> 0")
    end = F.col("l_linenumber") * 10 + 5 + F.col("l_partkey") % 5 + F.when(F.col("l_suppkey") % 11 == 0, 1).otherwise(0)
    return l.select(F.col("l_orderkey").alias("record"), (F.col("l_linenumber") * 10).alias("s"), end.alias("e"), F.when(F.col("l_suppkey") % 13 == 0, "X").otherwise(F.col("l_returnflag")).alias("type"), F.concat(F.lit("s"), (F.col("l_partkey") % 5).cast("string")).alias("source"))


def sides(spark, sf):
    """Gold and predicted spans of the same lines."""
    l = lines(spark, sf)
    return gold(spark, sf, l), predicted(spark, sf, l)


_MATCH = lambda keys: f"m AS (SELECT {', '.join(f'coalesce(g.{k}, p.{k}) AS {k}' for k in keys)}, (g.record IS NOT NULL AND p.record IS NOT NULL)::INT AS tp, (g.record IS NULL)::INT AS fp, (p.record IS NULL)::INT AS fn FROM (SELECT DISTINCT {', '.join(keys)} FROM gold) g FULL JOIN (SELECT DISTINCT {', '.join(keys)} FROM pred) p ON {' AND '.join(f'g.{k} = p.{k}' for k in keys)})"
_PRF = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0), 9) AS precision, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 9) AS recall, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 9) AS f1"
TYPED, UNTYPED = ["record", "s", "e", "type"], ["record", "s", "e"]


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("d06_span_match", f"{_BOTH}, {_MATCH(TYPED)} SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM m")
def d06(spark, sf):
    return S.match_spans(*sides(spark, sf), TYPED).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


@query("i04_strict_by_type", f"{_BOTH}, {_MATCH(TYPED)} SELECT type, {_PRF} FROM m GROUP BY type")
def i04_type(spark, sf):
    return rounded(S.prf(S.match_spans(*sides(spark, sf), TYPED), ["type"]), "precision", "recall", "f1")


@query("i04_strict_by_source", f"{_BOTH}, {_MATCH([*TYPED, 'source'])} SELECT source, {_PRF} FROM m GROUP BY source")
def i04_source(spark, sf):
    return rounded(S.prf(S.match_spans(*sides(spark, sf), [*TYPED, "source"]), ["source"]), "precision", "recall", "f1")


@query("i04_untyped", f"{_BOTH}, {_MATCH(UNTYPED)} SELECT {_PRF} FROM m")
def i04_untyped(spark, sf):
    return rounded(S.prf(S.match_spans(*sides(spark, sf), UNTYPED), []), "precision", "recall", "f1")


@query("i06_supported_types", f"{_BOTH}, {_MATCH(TYPED)} SELECT count(*) FILTER (WHERE type NOT IN ('A', 'N') AND fp = 0) AS unsupported_gold, sum(tp) FILTER (WHERE type IN ('A', 'N'))::BIGINT AS tp FROM m")
def i06(spark, sf):
    m = S.match_spans(*sides(spark, sf), TYPED)
    known = F.col("type").isin("A", "N")
    return m.agg(F.count_if(~known & (F.col("fp") == 0)).alias("unsupported_gold"), F.sum(F.when(known, F.col("tp"))).alias("tp"))


_BIO = _LI + "bio AS (SELECT l_orderkey AS record, l_linenumber AS idx, CASE l_suppkey % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'B-' || l_returnflag ELSE 'I-' || l_returnflag END AS label FROM li)"
_RUNS = _BIO + """, t AS (SELECT *, substr(label, 1, 1) AS tag, substr(label, 3) AS kind, lag(label) OVER w AS before, lag(idx) OVER w AS prev FROM bio WINDOW w AS (PARTITION BY record ORDER BY idx)),
f AS (SELECT *, tag = 'I' AND coalesce(before <> 'O' AND substr(before, 3) = kind AND prev = idx - 1, false) AS follows FROM t),
b AS (SELECT *, sum((tag <> 'O' AND NOT follows)::INT) OVER (PARTITION BY record ORDER BY idx) AS run FROM f),
runs AS (SELECT record, run, any_value(kind) AS type, min(idx) AS first, max(idx) AS last, max((tag = 'I' AND NOT follows)::INT) AS repaired FROM b WHERE tag <> 'O' GROUP BY record, run)"""


def bio(spark, sf):
    label = F.when(F.col("l_suppkey") % 4 == 0, F.lit("O")).when(F.col("l_suppkey") % 4 == 1, F.concat(F.lit("B-"), "l_returnflag")).otherwise(F.concat(F.lit("I-"), "l_returnflag"))
    return lines(spark, sf).select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("idx"), label.alias("label"))


@query("b17_bio_spans", f"WITH {_RUNS} SELECT record, type, first, last, repaired FROM runs")
def b17(spark, sf):
    return S.entity_runs(bio(spark, sf), "record", "idx", "label").select("record", "type", "first", "last", "repaired")


@query("b18_bio_spans_strict", f"WITH {_RUNS} SELECT record, type, first, last FROM runs WHERE repaired = 0")
def b18(spark, sf):
    return S.entity_runs(bio(spark, sf), "record", "idx", "label", repair=False).select("record", "type", "first", "last")


@query("i05_document_scores", f"WITH {_RUNS}, g AS (SELECT record, count(*) AS n FROM runs GROUP BY record), p AS (SELECT record, count(*) AS n FROM runs WHERE repaired = 0 GROUP BY record), a AS (SELECT DISTINCT l_orderkey AS record FROM li) SELECT count(*) FILTER (WHERE g.n > 0 AND p.n IS NULL) AS missed_documents, count(*) AS documents FROM a LEFT JOIN g USING (record) LEFT JOIN p USING (record)")
def i05(spark, sf):
    b = bio(spark, sf)
    runs = S.entity_runs(b, "record", "idx", "label").groupBy("record").agg(F.count_if(F.col("repaired") == 0).alias("strict"))
    j = b.select("record").distinct().join(runs, "record", "left")
    return j.agg(F.count_if(F.col("strict") == 0).alias("missed_documents"), F.count(F.lit(1)).alias("documents"))


@query("e17_token_statistics", f"WITH {_RUNS} SELECT (SELECT count(*) FROM bio) AS tokens, (SELECT count(DISTINCT record) FROM bio) AS documents, count(*) AS entities, count(DISTINCT record) AS positive FROM runs")
def e17(spark, sf):
    b = bio(spark, sf)
    runs = S.entity_runs(b, "record", "idx", "label").groupBy("record").agg(F.count(F.lit(1)).alias("k"))
    docs = b.groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(runs, "record", "left").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("k").alias("entities"), F.count("k").alias("positive"))


@query("e18_class_weights", f"WITH {_BIO}, c AS (SELECT label, count(*) AS n, 1 / sqrt(count(*)) AS w FROM bio GROUP BY label) SELECT label, n, round(w / avg(w) OVER (), 9) AS weight FROM c")
def e18(spark, sf):
    c = bio(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("w", 1 / F.sqrt("n"))
    #: one row a label
    return c.join(F.broadcast(c.agg(F.avg("w").alias("m"))), how="cross").select("label", "n", F.round(F.col("w") / F.col("m"), 9).alias("weight"))


@query("e16_span_statistics", f"WITH {_GOLD} SELECT source, count(DISTINCT record) AS records, count(*) AS spans, sum(e - s)::BIGINT AS characters, count(*) FILTER (WHERE type = 'R') AS r FROM gold GROUP BY source")
def e16(spark, sf):
    return gold(spark, sf).groupBy("source").agg(F.countDistinct("record").alias("records"), F.count(F.lit(1)).alias("spans"), F.sum(F.col("e") - F.col("s")).alias("characters"), F.count_if(F.col("type") == "R").alias("r"))


_ALIGN = _LI + """tok AS (SELECT l_orderkey AS record, l_linenumber AS idx, l_linenumber * 10 AS s, l_linenumber * 10 + 4 AS e FROM li),
spn AS (SELECT l_orderkey AS record, l_linenumber * 10 AS ss, l_linenumber * 10 + CASE WHEN l_suppkey % 3 = 0 THEN 14 ELSE 2 + l_suppkey % 3 END AS se, l_returnflag AS type FROM li WHERE l_suppkey % 5 = 0 AND l_linenumber % 2 = 1),
al AS (SELECT t.record, t.idx, t.s, t.e, ss, se, type FROM tok t LEFT JOIN spn p ON p.record = t.record AND t.s < p.se AND t.e > p.ss),
lb AS (SELECT record, idx, ss IS NOT NULL AND NOT (s >= ss AND e <= se) AS masked, CASE WHEN ss IS NOT NULL AND NOT (s >= ss AND e <= se) THEN NULL WHEN ss IS NULL THEN 'O' WHEN coalesce(lag(ss) OVER w = ss AND lag(se) OVER w = se, false) THEN 'I-' || type ELSE 'B-' || type END AS label FROM al WINDOW w AS (PARTITION BY record ORDER BY idx))"""


@query("b23_span_alignment", f"WITH {_ALIGN} SELECT record, idx, label, masked FROM lb")
def b23(spark, sf):
    l = lines(spark, sf)
    tokens = l.select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("idx"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 4).alias("end"))
    width = F.when(F.col("l_suppkey") % 3 == 0, 14).otherwise(F.col("l_suppkey") % 3 + 2)
    spans = l.where("l_suppkey % 5 = 0 AND l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("record"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + width).alias("end"), F.col("l_returnflag").alias("type"))
    return S.bio_labels(tokens, spans)


@query("d08_token_span_overlap", f"WITH {_ALIGN} SELECT count(*) FILTER (WHERE label IS NULL) AS masked, count(*) FILTER (WHERE label LIKE 'B-%') AS begins, count(*) FILTER (WHERE label LIKE 'I-%') AS goes_on FROM lb")
def d08(spark, sf):
    b = b23(spark, sf)
    return b.agg(F.count_if(F.col("label").isNull()).alias("masked"), F.count_if(F.col("label").startswith("B-")).alias("begins"), F.count_if(F.col("label").startswith("I-")).alias("goes_on"))


@query("b24_prediction_spans", f"WITH {_RUNS}, c AS (SELECT l_orderkey AS record, l_linenumber AS idx, l_discount * 10 AS conf FROM li) SELECT r.record, first, last, round(min(conf), 6) AS confidence, count(*) AS n FROM runs r JOIN c ON c.record = r.record AND c.idx BETWEEN first AND last GROUP BY r.record, first, last")
def b24(spark, sf):
    runs = S.entity_runs(bio(spark, sf), "record", "idx", "label")
    c = lines(spark, sf).select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("idx"), (F.col("l_discount") * 10).alias("conf"))
    j = runs.join(c, (runs["record"] == c["record"]) & F.col("idx").between(F.col("first"), F.col("last"))).drop(c["record"])
    return j.groupBy("record", "first", "last").agg(F.round(F.min("conf"), 6).alias("confidence"), F.count(F.lit(1)).alias("n"))


@query("b26_truncation_coverage", "SELECT l AS length, round(avg((w > l)::INT), 9) AS share_over FROM (SELECT len(string_split(coalesce(text, ''), ' ')) AS w FROM documents), (VALUES (128), (256), (512)) AS t(l) GROUP BY l")
def b26(spark, sf):
    w = table(spark, sf, "documents").select(F.size(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("w"))
    return w.select(F.explode(F.array(*map(F.lit, (128, 256, 512)))).alias("length"), "w").groupBy("length").agg(F.round(F.avg((F.col("w") > F.col("length")).cast("int")), 9).alias("share_over"))


@query("b25_windows", "WITH RECURSIVE " + _LI + "t AS (SELECT l_orderkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, least(l_quantity::INT, 60) AS n FROM li), w AS (SELECT r, i, n AS size, 1 AS win FROM t WHERE i = 1 UNION ALL SELECT t.r, t.i, CASE WHEN w.size + t.n > 60 THEN t.n ELSE w.size + t.n END, CASE WHEN w.size + t.n > 60 THEN w.win + 1 ELSE w.win END FROM w JOIN t ON t.r = w.r AND t.i = w.i + 1) SELECT r AS record, max(win)::BIGINT AS windows FROM w GROUP BY r")
def b25(spark, sf):
    l = lines(spark, sf).groupBy(F.col("l_orderkey").alias("record")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("n")))).alias("x"))
    return l.select("record", F.size(S.windows(F.transform("x", lambda x: x["n"]), 60)).cast("long").alias("windows"))


_MAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"


def addressed(spark, sf):
    """Documents with an address, and the spans of all their addresses."""
    d = table(spark, sf, "documents").where(F.col("text").rlike(_MAIL))
    return d.select("doc_id", "text", S.pattern_spans(F.col("text"), _MAIL, "EMAIL").alias("spans"))


@query("b27_email_attack", f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS v FROM documents) SELECT doc_id, replace(replace(v, '@', ' [at] '), '.', ' [dot] ') AS obfuscated, length(replace(replace(v, '@', ' [at] '), '.', ' [dot] ')) - length(v) AS grown FROM m")
def b27(spark, sf):
    r = S.attack_records(addressed(spark, sf), "doc_id", "text", "spans", ["email_obfuscation"])
    x = r.select("parent_id", "text", F.explode(F.arrays_zip("spans", "parent_spans")).alias("x"))
    n, before = F.col("x.spans.end") - F.col("x.spans.start"), F.col("x.parent_spans.end") - F.col("x.parent_spans.start")
    return x.select(F.col("parent_id").alias("doc_id"), F.substring(F.col("text"), F.col("x.spans.start") + 1, n).alias("obfuscated"), (n - before).alias("grown"))


def _joined_by(sep: str) -> str:
    return f"array_to_string(list_filter(string_split(v, ''), lambda c: c <> ''), {sep})"


def _replaced(value: str, pairs) -> str:
    for old, new in pairs:
        value = f"replace({value}, '{old}', '{new}')"
    return value


#: What each attack makes of an address ``v``.
_ATTACKED = {
    "character_substitution": f"translate(v, '{S.LOOKALIKE[0]}', '{S.LOOKALIKE[1]}')",
    "separator_insertion": _joined_by("chr(8203)"),
    "whitespace": _replaced("v", [(" ", "  ")]),
    "symbol_replacement": f"translate(v, '{S.FULLWIDTH[0]}', '{S.FULLWIDTH[1]}')",
    "email_obfuscation": _replaced("v", [("@", " [at] "), (".", " [dot] ")]),
    "phone_formatting": "v",
    "digit_words": f"trim({_replaced('v', [(str(i), f' {w} ') for i, w in enumerate(S.DIGITS)])})",
    "case": "translate(v, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')",
    "token_splitting": _joined_by("' '"),
}
_STARTS = "list_transform(generate_series(1, len({m})), lambda i: (coalesce(list_sum(list_transform({g}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0))::BIGINT)"
#: Views up to ``nx``: of each document and attack that changes it, the new text ``t``, its addresses ``a``, where they start, which changed.
_ADDRESSES = f"""ad AS (SELECT doc_id, regexp_extract_all(text, '{_MAIL}') AS m, string_split_regex(text, '{_MAIL}') AS g FROM documents WHERE regexp_matches(text, '{_MAIL}')),
ax AS ({' UNION ALL '.join(f"SELECT doc_id, '{k}' AS attack, m, g, list_transform(m, lambda v: {e}) AS a FROM ad" for k, e in _ATTACKED.items())}),
cx AS (SELECT *, list_transform(generate_series(1, len(m)), lambda i: a[i] <> m[i]) AS changed FROM ax),
nx AS (SELECT *, array_to_string(flatten(list_transform(generate_series(1, len(g)), lambda i: [g[i], coalesce(a[i], '')])), '') AS t, {_STARTS.format(m='a', g='g')} AS starts FROM cx WHERE list_contains(changed, true))"""


@query("b27_attack_records")
def b27_records(spark, sf):
    return S.attack_records(addressed(spark, sf), "doc_id", "text", "spans")


@query("b27_attacked_addresses", f"WITH {_ADDRESSES} SELECT doc_id, attack, md5(t) AS text, i::INT AS place, starts[i]::INT AS start, (starts[i] + length(a[i]))::INT AS stop, changed[i] AS changed FROM nx, unnest(generate_series(1, len(a))) AS u(i)")
def b27_addresses(spark, sf):
    r = b27_records(spark, sf).select(F.col("parent_id").alias("doc_id"), "attack", F.md5("text").alias("text"), F.posexplode(F.arrays_zip("spans", "entity_changed")).alias("place", "x"))
    return r.select("doc_id", "attack", "text", (F.col("place") + 1).alias("place"), F.col("x.spans.start").alias("start"), F.col("x.spans.end").alias("stop"), F.col("x.entity_changed").alias("changed"))


@query("i07_attack_scores", f"""WITH {_ADDRESSES},
fx AS (SELECT *, regexp_extract_all(t, '{_MAIL}') AS fm, string_split_regex(t, '{_MAIL}') AS fg FROM nx),
sx AS (SELECT attack, changed, fm, list_transform(generate_series(1, len(a)), lambda i: starts[i] || '-' || (starts[i] + length(a[i]))) AS gold, {_STARTS.format(m='fm', g='fg')} AS fs FROM fx),
hx AS (SELECT *, list_transform(generate_series(1, len(fm)), lambda i: fs[i] || '-' || (fs[i] + length(fm[i]))) AS found FROM sx),
rx AS (SELECT attack, len(list_filter(gold, lambda s: list_contains(found, s))) AS tp, len(gold) AS gold, len(found) AS found, len(list_filter(changed, lambda c: c)) AS eligible, len(list_filter(generate_series(1, len(gold)), lambda i: changed[i] AND NOT list_contains(found, gold[i]))) AS lost FROM hx),
gx AS (SELECT attack, count(*) AS records, sum(tp)::BIGINT AS tp, sum(found - tp)::BIGINT AS fp, sum(gold - tp)::BIGINT AS fn, sum(eligible)::BIGINT AS eligible, sum(lost)::BIGINT AS lost FROM rx GROUP BY attack),
px AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM gx),
kx(attack) AS (VALUES {', '.join(f"('{k}')" for k in S.ATTACKS)})
SELECT kx.attack, CASE WHEN records IS NULL THEN 'no_applicable_entities' ELSE 'scored' END AS status, records, tp, fp, fn, f1, eligible, lost, lost / eligible AS success_rate, 1 - f1 AS degradation FROM kx LEFT JOIN px ON px.attack = kx.attack""")
def i07_scores(spark, sf):
    #: the pattern both marks and detects the addresses
    return S.attack_scores(b27_records(spark, sf), S.pattern_spans(F.col("text"), _MAIL, "EMAIL"))


@query("b21_span_validation", "WITH " + _GOLD + " SELECT CASE WHEN e > 60 THEN 'range' END AS error, count(*) AS n FROM gold GROUP BY ALL")
def b21(spark, sf):
    g = gold(spark, sf).withColumn("spans", F.array(F.struct(F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"), "type")))
    return g.groupBy(S.span_errors(F.col("spans"), F.rpad(F.lit(""), 60, " ")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("b28_prefix_trim", "SELECT c_custkey, 'password: ' || c_name AS text, length('password: ') AS start FROM customer")
def b28(spark, sf):
    c = table(spark, sf, "customer").withColumn("text", F.concat(F.lit("password: "), "c_name"))
    return c.select("c_custkey", "text", F.length(F.regexp_extract("text", r"(?i)^(?:password|secret|pin)\s*(?:is|:|=)\s*", 0)).alias("start"))
