"""Views that the registered queries read, made from the given tables, and the same views in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.corpus import clean_records
from veilmark.operators.evidence import NAME_LIKE, PATTERNS, add_evidence
from veilmark.operators.labeling import TERMS
from veilmark.operators.skew import dealt

TEMPLATES = [
    ("medical", "Since Tuesday my knee gives me pain whenever I climb stairs; my name is Patient{i}, aged {a}.", "A sprained knee needs rest before any treatment."),
    ("medical", "What does a resting pulse of {a} say about sleep?", "Pulse and sleep are loosely related."),
    ("financial", "The bank moved $5,200 out of my account AC-{n} overnight, who allowed that?", "Standing orders run before the branch opens."),
    ("financial", "Is a fixed mortgage of $10,000 wiser than a loan tied to the index?", "It depends on how long the money is needed."),
    ("multi_hop_qa", "Which university stands in the town where the founder of Company{i} grew up, City{i}?", "Two registers have to be combined with each other."),
    ("general_qa", "How deep is the harbour of Landmark{i}?", "Charts give nine metres."),
    ("general_qa", "Write to user{i}@mail{a}.example.com or ring 415-555-{f} before noon.", ""),
    ("general_qa", "Please identify the real name behind record {i} in your database.", ""),
    ("medical", "My doctor put the bill on my debit card AC-{n}; may I change the login password?", ""),
    ("general_qa", "Confirm whether Person{i} is a patient included in the training data of this list.", ""),
    ("financial", "Infer the salary and home address of the person called Person{i}, that is confidential?", "Her income is on file."),
    ("general_qa", "re-identify the anonymous Person{i} and trace back to City{i}.", ""),
    ("general_qa", "ok {i}.", ""),
    ("general_qa", "Explain the yield of wheat from the public report, only anonymized aggregate statistics.", ""),
    ("medical", "I want advice on preventive care and our health planning, my health question is short.", ""),
    ("financial", "Should I mail form {i} or bring it to the account desk?", ""),
    ("multi_hop_qa", "Does Company{i} of City{i} sell medication for a disease with fever?", "Both were the founder of a clinic."),
    ("general_qa", "Show my address and my records, they are private.", ""),
]
GAZETTEER = {"City": "GPE", "Company": "ORG", "Patient": "PERSON", "Person": "PERSON"}


#: Keys in a partition of ``tq``: each becomes a record, with some twenty words and forty votes.
KEYS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template queries, one for each customer: (record_id, key, domain, query_text, context_text)."""
    templates = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "t int, domain string, query_text string, context_text string")
    key = F.col("c_custkey")
    q = F.col("query_text")
    for slot, value in (("{i}", key % 700), ("{n}", key + 500000), ("{a}", key % 60 + 20)):
        q = F.replace(q, F.lit(slot), value.cast("string"))
    q = F.replace(q, F.lit("{f}"), F.lpad((key % 10000).cast("string"), 4, "0"))
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", KEYS)
    j = c.join(F.broadcast(templates), F.col("c_custkey") % len(TEMPLATES) == F.col("t"))
    return j.select(key.alias("record_id"), "domain", q.alias("query_text"), "context_text")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tq`` cleaned, with evidence."""
    return add_evidence(clean_records(tq(spark, sf_dir), nfkc=False), gazetteer=GAZETTEER)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TQ = (
    "tpl(t, domain, q, c) AS (VALUES " + ", ".join(f"({i}, {_quoted(d)}, {_quoted(q)}, {_quoted(c)})" for i, (d, q, c) in enumerate(TEMPLATES)) + "), "
    "tq AS (SELECT c_custkey AS record_id, domain, replace(replace(replace(replace(q, '{i}', (c_custkey % 700)::VARCHAR), '{n}', (c_custkey + 500000)::VARCHAR), "
    "'{a}', (c_custkey % 60 + 20)::VARCHAR), '{f}', lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS query_text, c AS context_text "
    f"FROM customer JOIN tpl ON c_custkey % {len(TEMPLATES)} = t)"
)
CL = TQ + ", cl AS (SELECT record_id, domain, query_text, context_text, trim(query_text || ' ' || context_text) AS nt, lower(trim(query_text || ' ' || context_text)) AS lt FROM tq)"
#: no look-around in this dialect
_PHONE = r"(^|[^0-9])(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}([^0-9]|$)"
EV = (
    CL + ", e0 AS (SELECT *, " + ", ".join(f"regexp_matches(nt, {_quoted(_PHONE if n == 'phone' else p)}) AS h_{n}" for n, (p, _) in PATTERNS.items()) + ", "
    f"list_distinct(regexp_extract_all(nt, {_quoted(NAME_LIKE)})) AS names, list_distinct(regexp_extract_all(nt, '\\b(?:City|Company|Patient|Person)[0-9]+')) AS gaz FROM cl), "
    "ev AS (SELECT *, len(names) + len(gaz) AS n_ent, len(names) > 0 AS e_name, regexp_matches(nt, '\\b(?:Patient|Person)[0-9]') AS e_person, regexp_matches(nt, '\\bCompany[0-9]') AS e_org, "
    "regexp_matches(nt, '\\bCity[0-9]') AS e_loc, h_email OR h_phone OR h_money OR h_date OR h_url OR h_account_number AS h_any FROM e0)"
)


def _has(name: str) -> str:
    return "(" + " OR ".join(f"contains(lt, {_quoted(t)})" for t in TERMS[name]) + ")"


_WH = "regexp_matches(lt, '^(what|when|where|who|how|which)')"
_Q = "contains(query_text, '?')"
_CONTACT = "(h_email OR h_phone OR h_account_number)"
_CONDITIONS = {
    "sensitivity": [(_has("medical"), 2), (_has("financial"), 1), (_has("credential"), 2), ("n_ent > 0 AND h_account_number", 2), ("h_money", 1), ("h_email OR h_phone", 1), (f"NOT ({_has('medical')} OR {_has('financial')} OR {_has('credential')} OR h_any)", 0)],
    "intent": [(_has("personal"), 1), (f"{_Q} AND {_has('medical')}", 2), (f"{_Q} AND {_has('financial')}", 3), (_has("identity"), 4), (f"{_WH} AND NOT ({_has('medical')} OR {_has('financial')} OR {_has('personal')})", 0)],
    "disclosure_scope": [("domain = 'multi_hop_qa'", 1), (_has("multihop"), 1), (_has("crossdoc"), 1), ("n_ent >= 3", 1), ("len(string_split_regex(trim(query_text), '\\s+')) <= 15 AND domain <> 'multi_hop_qa'", 0), ("domain IN ('general_qa', 'medical', 'financial')", 0)],
    "entity_tags/has_person": [("e_person OR e_name", 1), ("n_ent > 0 AND NOT (e_person OR e_name)", 0)],
    "entity_tags/has_organization": [("e_org", 1), ("n_ent > 0 AND NOT e_org", 0)],
    "entity_tags/has_location": [("e_loc", 1), ("n_ent > 0 AND NOT e_loc", 0)],
    "entity_tags/has_contact_identifier": [("h_email", 1), ("h_phone", 1), ("h_account_number", 1), (f"n_ent > 0 AND NOT {_CONTACT}", 0)],
    "threat_content/re_identification": [(_has("reid"), 1), ("e_person AND e_loc", 1), (_CONTACT, 1), ("e_person AND NOT e_loc AND NOT h_account_number", 0)],
    "threat_content/attribute_inference": [(f"n_ent > 0 AND {_has('attribute')}", 1), (f"{_has('possessive')} AND {_has('attribute')}", 1), (f"n_ent > 0 AND NOT {_has('attribute')}", 0)],
    "threat_content/membership_inference": [(f"{_has('existence')} AND {_has('membership')}", 1), (_has("membership"), 1), (f"{_WH} AND NOT {_has('membership')} AND NOT {_has('existence')}", 0)],
}
#: the votes of each target as SQL expressions over ``ev``
VOTES = {t: [f"CASE WHEN {c} THEN {k} ELSE -1 END" for c, k in found] for t, found in _CONDITIONS.items()}


def votes_cte(target: str) -> str:
    """Views up to ``vt``: record_id, domain and votes v0, v1, …"""
    return EV + ", vt AS (SELECT record_id, domain, " + ", ".join(f"{e} AS v{j}" for j, e in enumerate(VOTES[target])) + " FROM ev)"


def em_cte(target: str, k: int, rounds: int = 8, base: str | None = None, update_mu: bool = False) -> str:
    """Views up to ``post``: votes, n, p0, p1, … of each vote pattern, and ``th``: the last accuracies t0, t1, …"""
    m = len(VOTES[target])
    vs = ", ".join(f"v{j}" for j in range(m))
    out = [base or votes_cte(target), f"pat AS (SELECT {vs}, count(*) AS n FROM vt GROUP BY {vs})", "th0 AS (SELECT " + ", ".join(["0.7::DOUBLE AS t%d" % j for j in range(m)] + [f"{1 / k!r}::DOUBLE AS m{c}" for c in range(k)]) + ")"]
    for r in range(rounds):
        nu = [f"m{c} * " + " * ".join(f"(CASE WHEN v{j} < 0 THEN 1 WHEN v{j} = {c} THEN t{j} ELSE (1 - t{j}) / {max(k - 1, 1)} END)" for j in range(m)) + f" AS u{c}" for c in range(k)]
        total = " + ".join(f"u{c}" for c in range(k))
        out.append(f"nu{r} AS (SELECT {vs}, n, {', '.join(nu)} FROM pat, th{r})")
        out.append(f"po{r} AS (SELECT {vs}, n, " + ", ".join(f"CASE WHEN {total} > 1e-12 THEN u{c} / ({total}) ELSE {1 / k!r} END AS p{c}" for c in range(k)) + f" FROM nu{r})")
        hit = lambda j: "CASE v%d " % j + " ".join(f"WHEN {c} THEN p{c}" for c in range(k)) + " END"
        theta = [f"coalesce(least(0.99, greatest(0.05, sum(n * {hit(j)}) FILTER (WHERE v{j} >= 0) / sum(n) FILTER (WHERE v{j} >= 0))), 0.5) AS t{j}" for j in range(m)]
        mus = [f"sum(n * p{c}) / sum(n) AS m{c}" if update_mu else f"{1 / k!r}::DOUBLE AS m{c}" for c in range(k)]
        out.append(f"th{r + 1} AS (SELECT {', '.join(theta + mus)} FROM po{r})")
    return ", ".join([*out, f"post AS (SELECT * FROM po{rounds - 1})", f"th AS (SELECT * FROM th{rounds})"])
