"""Queries over entities in full: scores on all levels, token windows with their contents, reliability records."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.operators import span_scores as E
from veilmark.operators import spans as S
from veilmark.plans.registry import query
from veilmark.plans.spans import _LI, lines

#: Mentions made from lines of orders: some types are rare, some orders have no gold, and predictions miss, move and mistype.
_TYPE = "CASE WHEN l_partkey % 211 = 0 THEN 'Z' || l_suppkey % 3 ELSE l_returnflag END"
_MENTIONS = _LI + f"""mg AS (SELECT l_orderkey AS record, 's' || l_orderkey % 5 AS source, l_linenumber * 10 AS s, l_linenumber * 10 + 5 + l_partkey % 5 AS e, {_TYPE} AS type FROM li WHERE l_partkey % 3 = 0),
mp AS (SELECT l_orderkey AS record, 's' || l_orderkey % 5 AS source, l_linenumber * 10 AS s, l_linenumber * 10 + 5 + l_partkey % 5 + (l_suppkey % 11 = 0)::INT AS e, CASE WHEN l_suppkey % 13 = 0 THEN 'X' ELSE {_TYPE} END AS type FROM li WHERE l_partkey % 3 = 0 AND l_suppkey % 7 <> 0 OR l_partkey % 37 = 1)"""


def mentions(spark, sf):
    l = lines(spark, sf)
    kind = F.when(F.col("l_partkey") % 211 == 0, F.concat(F.lit("Z"), (F.col("l_suppkey") % 3).cast("string"))).otherwise(F.col("l_returnflag"))
    start = F.col("l_linenumber") * 10
    end = start + 5 + F.col("l_partkey") % 5
    shared = [F.col("l_orderkey").alias("record"), F.concat(F.lit("s"), (F.col("l_orderkey") % 5).cast("string")).alias("source"), start.alias("start")]
    gold = l.where("l_partkey % 3 = 0").select(*shared, end.alias("end"), kind.alias("type"))
    moved, renamed = F.col("l_suppkey") % 11 == 0, F.col("l_suppkey") % 13 == 0
    found = l.where("l_partkey % 3 = 0 AND l_suppkey % 7 <> 0 OR l_partkey % 37 = 1").select(*shared, (end + moved.cast("int")).alias("end"), F.when(renamed, "X").otherwise(kind).alias("type"))
    return gold, found, l.select(F.col("l_orderkey").alias("record")), gold.where("record % 40 = 0").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


_SHARES = "CASE WHEN level NOT IN ('rare', 'untyped', 'clean') THEN round(coalesce(tp / nullif(tp + fp, 0), 0), 9) END AS precision, CASE WHEN level IN ('rare', 'untyped', 'clean') THEN round(tp / nullif(tp + fn, 0), 9) ELSE round(coalesce(tp / nullif(tp + fn, 0), 0), 9) END AS recall, CASE WHEN level NOT IN ('rare', 'untyped', 'clean') THEN round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) END AS f1"


@query("i04_strict_all_levels", f"""WITH {_MENTIONS},
j AS (SELECT coalesce(g.type, p.type) AS type, coalesce(g.source, p.source) AS source, (g.s IS NOT NULL AND p.s IS NOT NULL)::INT AS tp, (g.s IS NULL)::INT AS fp, (p.s IS NULL)::INT AS fn
  FROM (SELECT DISTINCT * FROM mg) g FULL JOIN (SELECT DISTINCT * FROM mp) p USING (record, source, s, e, type)),
u AS (SELECT (g.s IS NOT NULL AND p.s IS NOT NULL)::INT AS tp, (g.s IS NULL)::INT AS fp, (p.s IS NULL)::INT AS fn FROM (SELECT DISTINCT record, s, e FROM mg) g FULL JOIN (SELECT DISTINCT record, s, e FROM mp) p USING (record, s, e)),
b AS (SELECT type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM j GROUP BY type),
tr AS (SELECT type, count(*) AS n FROM mg WHERE record % 40 = 0 GROUP BY type),
r AS (SELECT b.* FROM b LEFT JOIN tr ON tr.type = b.type WHERE coalesce(n, 0) <= 10),
c AS (SELECT DISTINCT l_orderkey AS record FROM lineitem WHERE l_orderkey NOT IN (SELECT record FROM mg)),
k AS (SELECT count(*) FILTER (WHERE record NOT IN (SELECT record FROM mp)) AS tp, count(*) FILTER (WHERE record IN (SELECT record FROM mp)) AS fn FROM c),
a AS (SELECT 'type' AS level, type AS key, tp, fp, fn FROM b UNION ALL SELECT 'source', source, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM j GROUP BY source
  UNION ALL SELECT 'micro', '', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM j UNION ALL SELECT 'untyped', '', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM u
  UNION ALL SELECT 'rare', '', coalesce(sum(tp), 0)::BIGINT, coalesce(sum(fp), 0)::BIGINT, coalesce(sum(fn), 0)::BIGINT FROM r UNION ALL SELECT 'clean', '', tp, 0, fn FROM k)
SELECT level, key, tp, fp, fn, {_SHARES} FROM a
UNION ALL SELECT 'macro', '', NULL, NULL, NULL, NULL, NULL, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) FROM b""")
def i04_all(spark, sf):
    s = E.strict_scores(*mentions(spark, sf))
    return s.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


#: Gold labels that are valid, and predicted ones that need not be: (record, idx, gold, predicted).
_TAGS = _LI + """tg AS (SELECT l_orderkey AS record, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS idx,
  CASE WHEN l_orderkey % 4 = 0 OR l_suppkey % 3 = 0 THEN 'O' WHEN l_suppkey % 3 = 1 THEN 'B-' || l_returnflag ELSE 'I-' || l_returnflag END AS raw,
  CASE WHEN l_orderkey % 5 = 0 OR l_partkey % 4 = 0 THEN 'O' WHEN l_partkey % 4 = 1 THEN 'B-' || l_returnflag WHEN l_suppkey % 9 = 0 THEN 'I-X' ELSE 'I-' || l_returnflag END AS predicted FROM li),
tl AS (SELECT *, lag(raw) OVER (PARTITION BY record ORDER BY idx) AS before FROM tg),
tt AS (SELECT record, idx, CASE WHEN raw LIKE 'I-%' AND NOT coalesce(before <> 'O' AND substr(before, 3) = substr(raw, 3), false) THEN 'B-' || substr(raw, 3) ELSE raw END AS gold, predicted FROM tl)"""


def tagged(spark, sf):
    l = lines(spark, sf)
    s, p, flag = F.col("l_suppkey") % 3, F.col("l_partkey") % 4, F.col("l_returnflag")
    raw = F.when((F.col("l_orderkey") % 4 == 0) | (s == 0), "O").otherwise(F.concat(F.when(s == 1, "B-").otherwise("I-"), flag))
    predicted = F.when((F.col("l_orderkey") % 5 == 0) | (p == 0), "O").when(p == 1, F.concat(F.lit("B-"), flag)).when(F.col("l_suppkey") % 9 == 0, "I-X").otherwise(F.concat(F.lit("I-"), flag))
    rows = l.groupBy(F.col("l_orderkey").alias("record")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", raw.alias("raw"), predicted.alias("predicted")))).alias("t"))
    before = lambda i: F.when(i > 0, F.col("t")[i - 1]["raw"])
    kind = lambda c: F.substring(c, 3, 100)
    gold = F.transform("t", lambda x, i: F.when(x["raw"].startswith("I-") & ~F.coalesce((before(i) != "O") & (kind(before(i)) == kind(x["raw"])), F.lit(False)), F.concat(F.lit("B-"), kind(x["raw"]))).otherwise(x["raw"]))
    return rows.select("record", gold.alias("gold"), F.transform("t", lambda x: x["predicted"]).alias("predicted"))


def _runs(column: str, out: str) -> str:
    """Views in SQL: the entities of a label column, and which tokens are orphans."""
    return f"""{out}a AS (SELECT record, idx, {column} AS label, lag({column}) OVER (PARTITION BY record ORDER BY idx) AS before FROM tt),
{out}b AS (SELECT *, coalesce(label LIKE 'I-%' AND before <> 'O' AND substr(before, 3) = substr(label, 3), false) AS follows FROM {out}a),
{out}c AS (SELECT *, label LIKE 'I-%' AND NOT follows AS orphan, sum((label <> 'O' AND NOT follows)::INT) OVER (PARTITION BY record ORDER BY idx) AS run FROM {out}b),
{out} AS (SELECT record, min(idx) AS first, max(idx) AS last, any_value(substr(label, 3)) AS type FROM {out}c WHERE label <> 'O' GROUP BY record, run)"""


CATEGORIES = ["A", "N", "R", "X", "Q"]


@query("i05_class_scores", f"""WITH {_TAGS}, {_runs('gold', 'g')}, {_runs('predicted', 'p')},
k(type) AS (VALUES {', '.join(f"('{c}')" for c in CATEGORIES)}),
n AS (SELECT k.type, (SELECT count(*) FROM g WHERE g.type = k.type) AS support, (SELECT count(*) FROM p WHERE p.type = k.type) AS predicted, (SELECT count(*) FROM g JOIN p USING (record, first, last, type) WHERE type = k.type) AS true_positive FROM k),
a AS (SELECT 'class' AS level, * FROM n UNION ALL SELECT 'micro', NULL, sum(support)::BIGINT, sum(predicted)::BIGINT, sum(true_positive)::BIGINT FROM n)
SELECT level, type, support, predicted, true_positive, round(coalesce(true_positive / nullif(predicted, 0), 0), 9) AS precision, round(true_positive / nullif(support, 0), 9) AS recall, round(2 * true_positive / nullif(support + predicted, 0), 9) AS f1 FROM a
UNION ALL SELECT 'macro', NULL, NULL, NULL, NULL, NULL, NULL, round(avg(2 * true_positive / (support + predicted)), 9) FROM n WHERE support > 0""")
def i05_classes(spark, sf):
    s = E.class_scores(E.decoded(tagged(spark, sf), "gold", "predicted"), CATEGORIES)
    return s.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("i05_documents", f"""WITH {_TAGS}, {_runs('gold', 'g')}, {_runs('predicted', 'p')},
d AS (SELECT record, record IN (SELECT record FROM g) AS gold, record IN (SELECT record FROM p) AS found, record IN (SELECT record FROM pc WHERE orphan) AS invalid FROM (SELECT DISTINCT record FROM tt))
SELECT count(*) AS documents, count(*) FILTER (WHERE gold) AS positive, count(*) FILTER (WHERE gold AND NOT found) AS missed, count(*) FILTER (WHERE NOT gold) AS negative, count(*) FILTER (WHERE NOT gold AND found) AS false_positive,
  count(*) FILTER (WHERE invalid) AS invalid, round(count(*) FILTER (WHERE NOT gold AND found) / nullif(count(*) FILTER (WHERE NOT gold), 0), 9) AS false_positive_rate FROM d""")
def i05_documents(spark, sf):
    return E.document_scores(E.decoded(tagged(spark, sf), "gold", "predicted")).withColumn("false_positive_rate", F.round("false_positive_rate", 9))


class _NextWord:
    """A stand-in for a model: capitalised words are names, and each word depends on the one before; it fails on some texts."""

    def __call__(self, texts: list[str]) -> list:
        out = []
        for t in texts:
            if "\n" in t:
                raise ValueError("line breaks are not supported")
            words = [w for w in t.split(" ") if w]
            out.append(([(w, "NAME") for w in words if "A" <= w[0] <= "Z"], [(w, "next", words[i - 1] if i else "", w in ("-", "--")) for i, w in enumerate(words)]))
        return out


@query("b11_entities_and_dependencies", """WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, contains(t, chr(10)) AS bad, w, list_filter(generate_series(1, len(w)), lambda i: w[i] NOT IN ('-', '--'))[1:50] AS kept FROM w)
SELECT doc_id, CASE WHEN bad THEN '' ELSE array_to_string(list_filter(w, lambda x: x[1] >= 'A' AND x[1] <= 'Z'), ' ') END AS names, CASE WHEN bad THEN '' ELSE array_to_string(list_transform(kept, lambda i: w[i] || '<' || CASE WHEN i > 1 THEN w[i - 1] ELSE '' END), ' ') END AS triples,
  CASE WHEN bad THEN 'ValueError: line breaks are not supported' END AS error FROM d""")
def b11_dependencies(spark, sf):
    from veilmark.operators.hooks import annotate_texts
    from veilmark.plans.fixtures import table

    a = annotate_texts(table(spark, sf, "documents").select("doc_id", "text"), _NextWord, text_col="text").select("doc_id", "annotation.*")
    triples = F.transform("dependencies", lambda d: F.concat(d["token"], F.lit("<"), d["head"]))
    return a.select("doc_id", F.array_join(F.transform("entities", lambda e: e["text"]), " ").alias("names"), F.array_join(triples, " ").alias("triples"), "error")


BUDGET = 36
#: Tokens of an order's lines: as many subwords as the quantity says, none for some.
_PIECES = _LI + f"""tk AS (SELECT l_orderkey AS record, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS token, CASE WHEN l_partkey % 19 = 0 THEN 0 ELSE l_quantity::INT END AS n, l_partkey % 1000 AS p FROM li),
kp AS (SELECT *, least(greatest(n, 1), {BUDGET}) AS size, CASE WHEN n = 0 THEN [7] WHEN n > {BUDGET} THEN list_concat(list_transform(generate_series(1, {(BUDGET + 1) // 2}), lambda i: p + i), list_transform(generate_series(n - {BUDGET // 2} + 1, n), lambda i: p + i)) ELSE list_transform(generate_series(1, n), lambda i: p + i) END AS ids FROM tk)"""


def pieces(spark, sf):
    n = F.when(F.col("l_partkey") % 19 == 0, 0).otherwise(F.col("l_quantity").cast("int"))
    p = (F.col("l_partkey") % 1000).cast("int")
    ids = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(p + 1, p + n))
    return lines(spark, sf).groupBy(F.col("l_orderkey").alias("record")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", ids.alias("ids")))), lambda x: x["ids"]).alias("pieces"))


_PACKED = f"""wd AS (SELECT record, token, size, ids, size AS filled, 0 AS win FROM kp WHERE token = 0
  UNION ALL SELECT k.record, k.token, k.size, k.ids, CASE WHEN w.filled + k.size > {BUDGET} THEN k.size ELSE w.filled + k.size END, CASE WHEN w.filled + k.size > {BUDGET} THEN w.win + 1 ELSE w.win END FROM wd w JOIN kp k ON k.record = w.record AND k.token = w.token + 1)"""


@query("b25_window_contents", f"WITH RECURSIVE {_PIECES}, {_PACKED} SELECT record, win::INT AS win, min(token)::INT AS first, max(token)::INT AS last, string_agg(array_to_string(ids, ' '), ' ' ORDER BY token) AS ids, string_agg(token || repeat(' -1', size - 1), ' ' ORDER BY token) AS words FROM wd GROUP BY record, win")
def b25_contents(spark, sf):
    w = S.token_windows(pieces(spark, sf), "pieces", BUDGET, unknown=7).select("record", F.posexplode_outer("windows").alias("win", "w")).where("w is not null")  # a plain one would be filtered first by a second making of the windows
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return w.select("record", "win", "w.first", "w.last", text("w.ids").alias("ids"), text("w.words").alias("words"))


@query("b25_coverage", f"WITH RECURSIVE {_PIECES}, {_PACKED} SELECT count(DISTINCT record) AS documents, count(DISTINCT (record, win)) AS windows, count(*) AS tokens, (SELECT count(*) FROM tk WHERE n > {BUDGET}) AS oversized, (SELECT count(*) FROM tk WHERE n = 0) AS unknown, sum(len(ids))::BIGINT AS retained_subwords, (SELECT sum(greatest(n - {BUDGET}, 0))::BIGINT FROM tk) AS discarded_subwords FROM wd")
def b25_coverage(spark, sf):
    return S.window_coverage(S.token_windows(pieces(spark, sf), "pieces", BUDGET, unknown=7))


@query("b25_truncations", f"WITH {_PIECES} SELECT record, token::INT AS token, n AS subwords, {(BUDGET + 1) // 2} AS head, {BUDGET // 2} AS tail, n - {BUDGET} AS discarded FROM tk WHERE n > {BUDGET}")
def b25_truncations(spark, sf):
    w = S.token_windows(pieces(spark, sf), "pieces", BUDGET, unknown=7).select("record", F.explode_outer("ledger").alias("t")).where("t.discarded > 0")
    return w.select("record", "t.token", "t.subwords", "t.head", "t.tail", "t.discarded")


#: A distribution over O, B-T, I-T for each line; some tokens are no words.
_DIST = _LI + """wt AS (SELECT l_orderkey AS record, l_linenumber AS idx, l_partkey % 17 <> 0 AS valid, (1 + l_suppkey % 7)::DOUBLE AS a, (1 + l_partkey % 5)::DOUBLE AS b, (1 + (l_partkey + l_suppkey) % 6)::DOUBLE AS c FROM li),
pr AS (SELECT record, idx, valid, a / (a + b + c) AS o, b / (a + b + c) AS x, c / (a + b + c) AS y FROM wt),
pv AS (SELECT record, idx, o, greatest(o, x, y) AS conf, -(o * ln(o) + x * ln(x) + y * ln(y)) / ln(3) AS unc, CASE WHEN o >= x AND o >= y THEN 'O' WHEN x >= y THEN 'B-T' ELSE 'I-T' END AS label FROM pr WHERE valid),
pl AS (SELECT *, coalesce(label = 'I-T' AND lag(label) OVER (PARTITION BY record ORDER BY idx) <> 'O', false) AS follows FROM pv),
pn AS (SELECT *, sum((label <> 'O' AND NOT follows)::INT) OVER (PARTITION BY record ORDER BY idx) AS run FROM pl),
et AS (SELECT record, min(idx) AS first, max(idx) AS last, min(conf) AS confidence, max(unc) AS uncertainty FROM pn WHERE label <> 'O' GROUP BY record, run)"""


def reliability(spark, sf):
    a, b, c = ((1 + x).cast("double") for x in (F.col("l_suppkey") % 7, F.col("l_partkey") % 5, (F.col("l_partkey") + F.col("l_suppkey")) % 6))
    tokens = lines(spark, sf).select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("idx"), F.array(*[x / (a + b + c) for x in (a, b, c)]).alias("probs"), (F.col("l_partkey") % 17 != 0).alias("valid"))
    return E.reliability_records(tokens, ["O", "B-T", "I-T"])


@query("i18_entities", f"WITH {_DIST} SELECT record, first, last, 'T' AS type, round(confidence, 9) AS confidence, round(uncertainty, 9) AS uncertainty FROM et")
def i18_entities(spark, sf):
    e = reliability(spark, sf).select("record", F.explode("entities").alias("e")).select("record", "e.*")
    return e.withColumns({c: F.round(c, 9) for c in ("confidence", "uncertainty")})


@query("i18_records", f"WITH {_DIST}, r AS (SELECT DISTINCT l_orderkey AS record FROM li), e AS (SELECT record, count(*) AS n, min(confidence) AS c FROM et GROUP BY record), t AS (SELECT record, min(o) AS o, max(unc) AS u FROM pv GROUP BY record) SELECT record, coalesce(n, 0)::INT AS entities, round(coalesce(c, o, 0), 9) AS confidence, round(coalesce(u, 1), 9) AS uncertainty FROM r LEFT JOIN e USING (record) LEFT JOIN t USING (record)")
def i18_records(spark, sf):
    return reliability(spark, sf).select("record", F.size("entities").alias("entities"), F.round("confidence", 9).alias("confidence"), F.round("uncertainty", 9).alias("uncertainty"))
