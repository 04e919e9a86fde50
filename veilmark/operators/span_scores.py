"""Scores of typed entities on all levels at once, and reliability records, from rows that hold a document's labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.probs import argmax, normalised_entropy

RUN = "array<struct<first:int,last:int,type:string>>"
#: Types with no more mentions than this in training are rare.
RARE = 10


def decode_bio(labels: Column) -> Column:
    """struct<spans, orphans, malformed> of a document's BIO labels, by one automaton over them.

    Its state is the entity that is open. An I- of another type than that, or of none, is an orphan and opens an entity;
    labels that are neither O nor B- or I- with a type are malformed and close it. Entities are (first, last, type) of tokens."""
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast(RUN).alias("spans"), none.alias("open"), F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("orphans"), F.lit(0).alias("malformed"))
    closed = lambda s: F.concat(s["spans"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last"), s["open"].alias("type"))))

    def step(s, label):
        tagged = label.rlike(r"^[BI]-(?s:.+)$")
        kind = F.when(tagged, F.substring(label, 3, 1 << 20))
        goes_on = F.coalesce(tagged & label.startswith("I") & (kind == s["open"]), F.lit(False))
        return F.struct(
            F.when(s["open"].isNotNull() & ~goes_on, closed(s)).otherwise(s["spans"]).alias("spans"),
            kind.alias("open"),
            F.when(goes_on, s["first"]).otherwise(s["at"]).alias("first"),
            (s["at"] + 1).alias("at"),
            (s["orphans"] + (F.coalesce(tagged & label.startswith("I"), F.lit(False)) & ~goes_on).cast("int")).alias("orphans"),
            (s["malformed"] + (~F.coalesce(tagged | (label == "O"), F.lit(False))).cast("int")).alias("malformed"),
        )

    end = lambda s: F.struct(F.when(s["open"].isNotNull(), closed(s)).otherwise(s["spans"]).alias("spans"), s["orphans"].alias("orphans"), s["malformed"].alias("malformed"))
    return F.aggregate(labels, start, step, end)


def decoded(docs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``docs`` with ``gold_spans``, ``predicted_spans`` and ``invalid`` (the prediction has orphans).

    Refused, as the rows go by: malformed labels, gold with orphans, predictions that don't cover a document's tokens."""
    j = docs.withColumns({"_g": decode_bio(F.col(gold)), "_p": decode_bio(F.col(predicted))})
    wrong = (
        F.when(F.size(gold) != F.size(predicted), "predictions do not cover the tokens")
        .when((F.col("_g.malformed") > 0) | (F.col("_p.malformed") > 0), "malformed label")
        .when(F.col("_g.orphans") > 0, "gold label I- without a beginning")
    )
    spans = F.when(wrong.isNull(), F.col("_g.spans")).otherwise(F.raise_error(wrong).cast(RUN))
    return j.select(*docs.columns, spans.alias("gold_spans"), F.col("_p.spans").alias("predicted_spans"), (F.col("_p.orphans") > 0).alias("invalid"))


def _of_type(spans: Column, kind: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["type"] == kind))


def class_scores(decoded_docs: DataFrame, categories: list[str]) -> DataFrame:
    """(level, type, support, predicted, true_positive, precision, recall, f1): each category, then ``micro`` and ``macro``.

    Entities match on tokens and type. A category without gold has no recall, one with neither gold nor predictions no F1;
    macro is the mean F1 of the categories with gold. Documents are counted where they are; one shuffle of a row a category."""
    both = F.array_intersect("gold_spans", "predicted_spans")
    kinds = F.array_union(F.transform("gold_spans", lambda s: s["type"]), F.transform("predicted_spans", lambda s: s["type"]))
    counts = F.transform(kinds, lambda k: F.struct(k.alias("type"), _of_type(F.col("gold_spans"), k).alias("g"), _of_type(F.col("predicted_spans"), k).alias("p"), _of_type(F.col("_both"), k).alias("t")))
    rows = decoded_docs.withColumn("_both", both).select(F.explode_outer(counts).alias("c")).where("c is not null").select("c.*")  # a plain one would be filtered first by a second decoding
    #: a row for each category, whether met or not
    known = decoded_docs.sparkSession.createDataFrame([(k, 0, 0, 0) for k in dict.fromkeys(categories)], "type string, g int, p int, t int")
    sums = [F.sum(c).alias(n) for c, n in (("g", "support"), ("p", "predicted"), ("t", "true_positive"))]
    levels = rows.unionByName(known).groupingSets([["type"], []], "type").agg(F.grouping("type").alias("_all"), *sums)
    t, g, p = F.col("true_positive"), F.col("support"), F.col("predicted")
    levels = levels.where((F.col("_all") == 1) | F.col("type").isin(list(categories))).select(
        F.when(F.col("_all") == 1, "micro").otherwise("class").alias("level"), "type", "support", "predicted", "true_positive",
        F.when(p > 0, t / p).otherwise(0.0).alias("precision"), F.when(g > 0, t / g).alias("recall"), F.when(g + p > 0, 2 * t / (g + p)).alias("f1"))
    none = lambda kind: F.lit(None).cast(kind)
    macro = levels.where("level = 'class' and support > 0").agg(F.avg("f1").alias("f1")).select(F.lit("macro").alias("level"), none("string").alias("type"), *[none("long").alias(c) for c in ("support", "predicted", "true_positive")], none("double").alias("precision"), none("double").alias("recall"), "f1")
    return levels.unionByName(macro)


def document_scores(decoded_docs: DataFrame) -> DataFrame:
    """One row: documents with entities and those of them where nothing was found; documents without and those where something
    was, with their rate (null without any); documents whose predicted labels are invalid."""
    gold, found = F.size("gold_spans") > 0, F.size("predicted_spans") > 0
    n = decoded_docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(gold).alias("positive"), F.count_if(gold & ~found).alias("missed"), F.count_if(~gold).alias("negative"), F.count_if(~gold & found).alias("false_positive"), F.count_if("invalid").alias("invalid"))
    return n.withColumn("false_positive_rate", F.when(F.col("negative") > 0, F.col("false_positive") / F.col("negative")))


def strict_scores(gold: DataFrame, predicted: DataFrame, records: DataFrame, train_mentions: DataFrame, rare: int = RARE) -> DataFrame:
    """(level, key, tp, fp, fn, precision, recall, f1) of mentions (record, source, start, end, type), on all levels at once.

    Levels: ``micro``; each ``type`` and ``source``; ``macro``, the mean F1 of types; ``rare``, types with at most ``rare``
    mentions in ``train_mentions`` (type, n); ``untyped``, places alone; ``clean``, where tp are the ``records`` without gold in which
    nothing was found, fn the others without gold. Repeated mentions count once. Ratios are 0 where a denominator is, but the
    recalls of rare, untyped and clean are null. Mentions are shuffled once by place, where both sides' types meet, and once
    more as one flag a record; all levels are summed in one aggregate of a row a level and key."""
    side = lambda df, g: df.select("record", "source", "start", "end", "type", F.lit(g).alias("_gold"))
    both = side(gold, True).unionByName(side(predicted, False))
    of = lambda g: F.array_sort(F.collect_set(F.when(F.col("_gold") == g, F.col("type"))))
    places = both.groupBy("record", "start", "end").agg(F.max("source").alias("source"), of(True).alias("g"), of(False).alias("p"))
    g, p, one = F.col("g"), F.col("p"), lambda c: c.cast("int")
    row = lambda level, key, tp, fp, fn: F.struct(F.lit(level).alias("level"), key.cast("string").alias("key"), tp.cast("int").alias("tp"), fp.cast("int").alias("fp"), fn.cast("int").alias("fn"))
    typed = F.transform(F.array_union(g, p), lambda t: row("type", t, F.array_contains(g, t) & F.array_contains(p, t), ~F.array_contains(g, t), ~F.array_contains(p, t)))
    sums = (F.size(F.array_intersect(g, p)), F.size(F.array_except(p, g)), F.size(F.array_except(g, p)))
    in_g, in_p = F.size(g) > 0, F.size(p) > 0
    levels = F.concat(typed, F.array(row("micro", F.lit(""), *sums), row("source", F.col("source"), *sums), row("untyped", F.lit(""), one(in_g & in_p), one(~in_g), one(~in_p))))
    summed = places.select(F.explode(levels).alias("x")).select("x.*").groupBy("level", "key").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    # a row a type
    types = summed.where("level = 'type'").join(F.broadcast(train_mentions.groupBy("type").agg(F.sum("n").alias("_n"))), F.col("key") == F.col("type"), "left").where(F.coalesce("_n", F.lit(0)) <= rare)
    rare_row = types.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("rare").alias("level"), F.lit("").alias("key"), "tp", "fp", "fn")
    met = both.groupBy("record").agg(F.max("_gold").alias("g"), F.max(~F.col("_gold")).alias("p")).agg(F.count_if("g").alias("gold"), F.count_if(~F.col("g") & F.col("p")).alias("found"))
    #: one row each
    clean = met.crossJoin(records.agg(F.countDistinct("record").alias("n"))).select(F.lit("clean").alias("level"), F.lit("").alias("key"), (F.col("n") - F.col("gold") - F.col("found")).alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("found").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    only_recall = F.col("level").isin("rare", "untyped", "clean")
    out = summed.unionByName(rare_row).unionByName(clean).select(
        "level", "key", "tp", "fp", "fn", F.when(~only_recall, share(tp, tp + fp)).alias("precision"),
        F.when(only_recall & (tp + fn == 0), None).otherwise(share(tp, tp + fn)).alias("recall"), F.when(~only_recall, share(2 * tp, 2 * tp + fp + fn)).alias("f1"))
    none = lambda kind: F.lit(None).cast(kind)
    macro = out.where("level = 'type'").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1")).select(F.lit("macro").alias("level"), F.lit("").alias("key"), *[none("long").alias(c) for c in ("tp", "fp", "fn")], *[none("double").alias(c) for c in ("precision", "recall")], "f1")
    return out.unionByName(macro)


def reliability_records(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """(record, entities, confidence, uncertainty) from tokens (record, idx, probs, valid): a distribution over ``labels`` each.

    Labels are the likeliest, the first of equals, decoded as BIO with orphans opening entities. An entity has the least
    confidence and the greatest normalised entropy of its tokens; a record the least confidence of its entities, or without
    any the least P(first label) of its valid tokens, 0 without those, and the greatest entropy of valid tokens, or 1. Tokens
    that aren't valid are left out before decoding. One shuffle of tokens by record; a record's tokens are one row."""
    names = F.array(*map(F.lit, labels))
    each = F.struct("idx", F.element_at(names, argmax(F.col("probs")) + 1).alias("label"), F.array_max("probs").alias("c"), F.col("probs")[0].alias("o"), normalised_entropy(F.col("probs")).alias("u"))
    rows = tokens.groupBy("record").agg(F.array_sort(F.collect_list(F.when(F.col("valid"), each))).alias("t"))
    spans = decode_bio(F.transform("t", lambda x: x["label"]))["spans"]
    part = lambda s: F.slice("t", s["first"] + 1, s["last"] - s["first"] + 1)
    entity = lambda s: F.struct(F.col("t")[s["first"]]["idx"].alias("first"), F.col("t")[s["last"]]["idx"].alias("last"), s["type"].alias("type"), F.array_min(F.transform(part(s), lambda x: x["c"])).alias("confidence"), F.array_max(F.transform(part(s), lambda x: x["u"])).alias("uncertainty"))
    rows = rows.withColumn("spans", spans).withColumn("entities", F.transform("spans", entity))
    confidence = F.coalesce(F.array_min(F.transform("entities", lambda e: e["confidence"])), F.array_min(F.transform("t", lambda x: x["o"])), F.lit(0.0))
    return rows.select("record", "entities", confidence.alias("confidence"), F.coalesce(F.array_max(F.transform("t", lambda x: x["u"])), F.lit(1.0)).alias("uncertainty"))
