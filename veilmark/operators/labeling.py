"""Labeling functions as Column expressions, and the vote matrix they make."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.text import contains_any
from veilmark.operators.evidence import hits

ABSTAIN = -1
# The dimensions and their labels.
TAXONOMY = {
    "entity_tags": ["has_person", "has_organization", "has_location", "has_contact_identifier"],
    "sensitivity": ["low", "medium", "high"],
    "intent": ["general_information", "personal_information_request", "medical_information_request", "financial_information_request", "identity_related_request"],
    "disclosure_scope": ["single_document", "multi_document"],
    "threat_content": ["re_identification", "attribute_inference", "membership_inference"],
}
MULTI_LABEL = {"entity_tags", "threat_content"}
# The terms of the labeling functions.
TERMS = {
    "medical": ["diagnosis", "diagnosed", "patient", "doctor", "treatment", "medication", "symptom", "disease", "prescribed", "hospital", "blood", "fever", "pain"],
    "financial": ["account", "balance", "invest", "mortgage", "salary", "credit", "debit", "bank", "loan", "routing", "income", "tax", "fund"],
    "credential": ["password", "ssn", "social security", "pin", "otp", "login", "credential"],
    "personal": ["my name", "i am", "my address", "i live at", "my age", "my id"],
    "identity": ["who is", "who am i", "identify", "real name", "identity"],
    "multihop": ["also", "same person", "both", "the founder of", "which university"],
    "crossdoc": ["cross-reference", "linking", "combined with", "together with"],
    "reid": ["re-identify", "reidentify", "de-anonymize", "deanonymize", "trace back to"],
    "attribute": ["salary", "age", "income", "condition", "diagnosis", "address", "phone number", "email address", "date of birth", "dob"],
    "membership": ["in the dataset", "in your database", "in the records", "used for training", "part of the corpus", "included in", "member of"],
    "existence": ["is there", "does", "was", "were", "have", "has", "had"],
    "possessive": ["'s", " his ", " her ", " their "],
}
STARTS_WH = r"^(?:what|when|where|who|how|which)"

_registry: dict[str, dict[str, Column | Callable[[], Column]]] = {}


def vote(condition: Column, label: int) -> Column:
    return F.when(condition, label).otherwise(ABSTAIN)


def labeling_function(dimension: str, name: str):
    """Registers a user's function that gives a Column; its votes pass the same guard as the built-in ones."""

    def add(f: Callable[[], Column]):
        _registry.setdefault(dimension, {})[name] = f
        return f

    return add


def guarded(v: Column, k: int) -> Column:
    """A vote out of range, or missing, abstains."""
    return F.when(v.between(0, k - 1), v).otherwise(ABSTAIN).cast("int")


def term(name: str, word_boundary: bool = False) -> Column:
    return contains_any(F.lower("normalized_text"), TERMS[name], word_boundary)


def labelled(*labels: str) -> Column:
    return F.exists("entities", lambda e: e["label"].isin(*labels))


def term_lf(name: str, label: int, question: bool = False) -> Column:
    return vote(term(name) & F.contains("query_text", F.lit("?")) if question else term(name), label)


def presence_lf(*labels: str) -> Column:
    return vote(labelled(*labels), 1)


def absence_lf(*labels: str) -> Column:
    return vote((F.size("entities") > 0) & ~labelled(*labels), 0)


def entity_tag_lfs() -> dict[str, dict[str, Column]]:
    contact = hits("email") | hits("phone") | hits("account_number")
    return {
        "has_person": {"lf_has_person": presence_lf("PERSON", "PROPN_HEURISTIC"), "lf_no_person": absence_lf("PERSON", "PROPN_HEURISTIC")},
        "has_organization": {"lf_has_organization": presence_lf("ORG"), "lf_no_organization": absence_lf("ORG")},
        "has_location": {"lf_has_location": presence_lf("GPE", "LOC"), "lf_no_location": absence_lf("GPE", "LOC")},
        "has_contact_identifier": {"lf_has_email": vote(hits("email"), 1), "lf_has_phone": vote(hits("phone"), 1), "lf_has_account_number": vote(hits("account_number"), 1), "lf_no_contact_identifier": vote((F.size("entities") > 0) & ~contact, 0)},
    }


def sensitivity_lfs() -> dict[str, Column]:
    quiet = ~(term("medical") | term("financial") | term("credential")) & (F.size("regex_matches") == 0)
    return {
        "lf_sensitivity_medical_terms": term_lf("medical", 2),
        "lf_sensitivity_financial_terms": term_lf("financial", 1),
        "lf_sensitivity_credential_terms": term_lf("credential", 2),
        "lf_sensitivity_high_entity_and_account": vote((F.size("entities") > 0) & hits("account_number"), 2),
        "lf_sensitivity_numeric_financial_pattern": vote(hits("money"), 1),
        "lf_sensitivity_contact_identifier_present": vote(hits("email") | hits("phone"), 1),
        "lf_sensitivity_default_low": vote(quiet, 0),
    }


def intent_lfs() -> dict[str, Column]:
    plain = F.lower("normalized_text").rlike(STARTS_WH) & ~(term("medical") | term("financial") | term("personal"))
    return {
        "lf_intent_personal_info": term_lf("personal", 1),
        "lf_intent_medical": term_lf("medical", 2, question=True),
        "lf_intent_financial": term_lf("financial", 3, question=True),
        "lf_intent_identity": term_lf("identity", 4),
        "lf_intent_general_question": vote(plain, 0),
    }


def disclosure_lfs() -> dict[str, Column]:
    n_words = F.size(F.split(F.trim("query_text"), r"(?U)\s+"))
    return {
        "lf_disclosure_multihop_domain": vote(F.col("domain") == "multi_hop_qa", 1),
        "lf_disclosure_multihop_terms": term_lf("multihop", 1),
        "lf_disclosure_crossdoc_terms": term_lf("crossdoc", 1),
        "lf_disclosure_multiple_entities": vote(F.size("entities") >= 3, 1),
        "lf_disclosure_single_short_query": vote((n_words <= 15) & (F.col("domain") != "multi_hop_qa"), 0),
        "lf_disclosure_default_single": vote(F.col("domain").isin("general_qa", "medical", "financial"), 0),
    }


def threat_lfs() -> dict[str, dict[str, Column]]:
    has_any = F.size("entities") > 0
    person, place = labelled("PERSON"), labelled("GPE", "LOC")
    plain = F.lower("normalized_text").rlike(STARTS_WH) & ~term("membership") & ~term("existence")
    return {
        "re_identification": {
            "lf_threat_reid_terms": term_lf("reid", 1),
            "lf_threat_reid_person_and_location": vote(person & place, 1),
            "lf_threat_reid_identifier": vote(hits("email") | hits("phone") | hits("account_number"), 1),
            "lf_threat_reid_person_without_location": vote(person & ~place & ~hits("account_number"), 0),
        },
        "attribute_inference": {
            "lf_threat_attr_entity_and_attribute": vote(has_any & term("attribute"), 1),
            "lf_threat_attr_possessive": vote(term("possessive") & term("attribute"), 1),
            "lf_threat_attr_entity_without_attribute": vote(has_any & ~term("attribute"), 0),
        },
        "membership_inference": {
            "lf_threat_member_existence": vote(term("existence") & term("membership"), 1),
            "lf_threat_member_dataset_ref": vote(term("membership"), 1),
            "lf_threat_member_no_dataset_ref": vote(plain, 0),
        },
    }


def functions_of(target: str) -> tuple[dict[str, Column], int]:
    """The labeling functions of a dimension, or of a category of a multi-label one, and its number of classes."""
    single = {"sensitivity": sensitivity_lfs, "intent": intent_lfs, "disclosure_scope": disclosure_lfs}
    if target in single:
        found, k = single[target](), len(TAXONOMY[target])
    else:
        dimension, category = target.split("/")
        found, k = {"entity_tags": entity_tag_lfs, "threat_content": threat_lfs}[dimension]()[category], 2
    return found | {n: f() for n, f in _registry.get(target, {}).items()}, k


def targets() -> list[str]:
    return [t for d in TAXONOMY for t in ([f"{d}/{c}" for c in TAXONOMY[d]] if d in MULTI_LABEL else [d])]


def vote_matrix(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``df`` with a column of votes (array<int>) for each target, all made in one projection."""
    made = {}
    for t in wanted or targets():
        found, k = functions_of(t)
        made[f"votes_{t.replace('/', '_')}"] = F.array(*[guarded(v, k) for v in found.values()])
    return df.withColumns(made)


def lf_report(df: DataFrame, votes: str, names: list[str], by: str | None = None) -> DataFrame:
    """(group, lf, coverage, conflict, n): of each function, the share of rows where it votes, and where it votes against another."""
    fired = F.filter(F.array_distinct(F.col(votes)), lambda v: v >= 0)
    long = df.select(*([F.col(by).alias("grp")] if by else [F.lit("all").alias("grp")]), F.size(fired).alias("kinds"), F.posexplode(votes).alias("j", "v"))
    out = long.groupBy("grp", "j").agg(F.avg(F.when(F.col("v") >= 0, 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.when((F.col("v") >= 0) & (F.col("kinds") > 1), 1.0).otherwise(0.0)).alias("conflict"), F.count(F.lit(1)).alias("n"))
    return out.select("grp", F.element_at(F.array(*map(F.lit, names)), F.col("j") + 1).alias("lf"), "coverage", "conflict", "n")


def matrix_report(df: DataFrame, votes: str) -> DataFrame:
    """One row: rows, share with conflicting votes, share where all abstain."""
    kinds = F.size(F.filter(F.array_distinct(F.col(votes)), lambda v: v >= 0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(kinds > 1, 1.0).otherwise(0.0)).alias("conflict_ratio"), F.avg(F.when(kinds == 0, 1.0).otherwise(0.0)).alias("all_abstain_ratio"))


def majority(votes: Column, k: int) -> Column:
    """Share of votes for each class; uniform where none is cast."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.size(F.filter(votes, lambda v: v == c)).cast("double"))
    n = F.size(F.filter(votes, lambda v: v >= 0))
    return F.when(n > 0, F.transform(counts, lambda c: c / n)).otherwise(F.array_repeat(F.lit(1.0 / k), k))


def unanimous_fallback(votes: Column, probs: Column, suppressed: list[int], k: int) -> Column:
    """One-hot where all votes cast are for one suppressed class; else as given."""
    cast = F.filter(F.array_distinct(votes), lambda v: v >= 0)
    only = F.when(F.size(cast) == 1, cast[0])
    return F.when(only.isin(*suppressed), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.when(c == only, 1.0).otherwise(0.0))).otherwise(probs) if suppressed else probs


def inconsistent(stored: DataFrame, again: DataFrame, id_col: str, votes: str, probs: str, eps: float = 1e-6) -> DataFrame:
    """(id, reason, largest): records whose stored votes or posteriors are not what was computed again, or that are on one side only."""
    a = stored.select(F.col(id_col).alias("_a"), F.col(votes).alias("_va"), F.col(probs).alias("_pa"))
    b = again.select(F.col(id_col).alias("_b"), F.col(votes).alias("_vb"), F.col(probs).alias("_pb"))
    j = a.join(b.hint("merge"), F.col("_a") == F.col("_b"), "full")
    gap = F.aggregate(F.zip_with("_pa", "_pb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, F.coalesce(x, F.lit(float("inf")))))
    reason = F.when(F.col("_b").isNull(), "not computed").when(F.col("_a").isNull(), "not stored").when(~F.col("_va").eqNullSafe(F.col("_vb")), "votes").when(gap > eps, "posterior")
    return j.select(F.coalesce("_a", "_b").alias(id_col), reason.alias("reason"), gap.alias("largest")).where("reason is not null")


def vote_diagnostics(df: DataFrame, votes: str, by: list[str]) -> DataFrame:
    """(grp, n, overlap, conflict, all_abstain) of all rows and of each value of each column of ``by``: shares of rows where two
    functions or more vote, where they disagree, and where none votes."""
    cast = F.filter(F.col(votes), lambda v: v >= 0)
    rows = df.select(*by, F.size(cast).alias("k"), F.size(F.array_distinct(cast)).alias("kinds"))
    share = lambda c: F.avg(c.cast("int"))
    g = rows.groupingSets([[], *[[c] for c in by]], *by).agg(F.count(F.lit(1)).alias("n"), share(F.col("k") > 1).alias("overlap"), share(F.col("kinds") > 1).alias("conflict"), share(F.col("k") == 0).alias("all_abstain"), F.grouping_id().alias("gid"))
    last = len(by) - 1
    which = [F.when(F.col("gid").bitwiseAND(F.lit(1 << (last - i))) == 0, F.concat(F.lit(f"{c}/"), F.coalesce(F.col(c), F.lit("")))) for i, c in enumerate(by)]
    return g.select(F.coalesce(*which, F.lit("all")).alias("grp"), "n", "overlap", "conflict", "all_abstain")


def class_support(df: DataFrame, votes: str, probs: str, k: int) -> DataFrame:
    """(class, fired, voted, majority, final, differs) of each class: votes for it, rows with one, rows with votes whose majority
    and whose posterior it is first in, and rows with votes that it is first in by one of the two only."""
    first = lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int")
    rows = df.select(F.col(votes).alias("v"), first(majority(F.col(votes), k)).alias("m"), first(F.col(probs)).alias("f"), F.exists(votes, lambda v: v >= 0).alias("any"))
    long = rows.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    here = F.size(F.filter("v", lambda v: v == F.col("class")))
    m, f = F.col("any") & (F.col("m") == F.col("class")), F.col("any") & (F.col("f") == F.col("class"))
    return long.groupBy("class").agg(F.sum(here).cast("long").alias("fired"), F.count_if(here > 0).alias("voted"), F.count_if(m).alias("majority"), F.count_if(f).alias("final"), F.count_if(m != f).alias("differs"))


#: What labels of one record contradict, as conditions in SQL over domain, text (lower case), intent, sensitivity, and the
#: probability that an organization is named.
CONTRADICTIONS = {
    "medical_intent_elsewhere": "domain <> 'medical' AND intent = 'medical_information_request'",
    "financial_intent_elsewhere": "domain <> 'financial' AND intent = 'financial_information_request' AND NOT text RLIKE 'tariff|tax|stock|trade'",
    "identity_in_general_questions": "domain = 'general_qa' AND intent = 'identity_related_request'",
    "sensitive_but_general": "sensitivity = 'high' AND intent = 'general_information'",
    "medical_but_harmless": "domain = 'medical' AND intent = 'medical_information_request' AND sensitivity = 'low'",
    "medical_intent_in_hops": "domain = 'multi_hop_qa' AND intent = 'medical_information_request'",
    "organization_in_questions": "domain IN ('general_qa', 'multi_hop_qa') AND organization > 0.99",
}


def contradictions(df: DataFrame) -> DataFrame:
    """(domain, rule, n, rate): how many rows of a domain break each rule, and which share of the domain's rows; ``df`` has domain,
    text, intent, sensitivity and organization."""
    broken = F.array_compact(F.array(*[F.when(F.expr(when), F.lit(n)) for n, when in CONTRADICTIONS.items()]))
    rows = df.select("domain", broken.alias("rules"))
    size = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("_rows"))
    hit = rows.select("domain", F.explode("rules").alias("rule")).groupBy("domain", "rule").agg(F.count(F.lit(1)).alias("n"))
    return hit.join(size.hint("merge"), "domain").select("domain", "rule", "n", (F.col("n") / F.col("_rows")).alias("rate"))
