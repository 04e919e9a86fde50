"""Typed character spans: from tokens and back, checks, windows and scores."""

from __future__ import annotations

from array import array
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

SPAN = "array<struct<start:int,end:int,type:string>>"


#: Rows of a batch that are Python objects at once.
SLICE = 64


@F.arrow_udf(T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())]))
def token_offsets(tokens: pa.Array, text: pa.Array) -> pa.Array:
    """Where each token lies in its text, one after another; ``##`` goes on without a blank. Skipped text is an error.

    A batch stays in Arrow: ``SLICE`` rows at a time become Python objects, offsets are four bytes each."""
    starts, ends, upto, found, errors = array("i"), array("i"), array("i", [0]), [], []

    def one(words, t):
        at, first = 0, len(starts)
        for w in words or ():
            piece = w[2:] if w.startswith("##") else w
            i = t.find(piece, at)
            if i < 0 or (t[at:i].strip() != ""):
                del starts[first:], ends[first:]
                return False, f"token {w!r} does not follow"
            starts.append(i)
            ends.append(i + len(piece))
            at = i + len(piece)
        return True, "text left over" if t[at:].strip() else None

    for lo in range(0, len(text), SLICE):
        for words, t in zip(tokens.slice(lo, SLICE).to_pylist(), text.slice(lo, SLICE).to_pylist()):
            ok, error = one(words, t or "")
            found.append(ok)
            errors.append(error)
            upto.append(len(starts))
    gone = pa.array([not ok for ok in found], pa.bool_())
    lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(x, pa.int32()), mask=gone) for x in (starts, ends)]
    return pa.StructArray.from_arrays([*lists, pa.array(errors, pa.string())], names=["starts", "ends", "error"])


def entity_runs(tokens: DataFrame, record: str, idx: str, label: str, repair: bool = True) -> DataFrame:
    """``tokens`` in runs: (record, run, type, first, last, repaired) of each entity in BIO labels.

    An I- that doesn't go on from a token of its type begins an entity (``repair``) or is left out."""
    w = Window.partitionBy(record).orderBy(idx)
    kind, kind_before = F.substring(label, 3, 1000), F.lag(F.substring(label, 3, 1000)).over(w)
    tag = F.substring(label, 1, 1)
    follows = (tag == "I") & F.coalesce(F.lag(F.col(label)).over(w) != "O", F.lit(False)) & F.coalesce(kind == kind_before, F.lit(False)) & F.coalesce(F.lag(F.col(idx)).over(w) == F.col(idx) - 1, F.lit(True))
    t = tokens.withColumns({"_orphan": (tag == "I") & ~follows, "_begin": (tag == "B") | ((tag == "I") & ~follows), "_type": kind})
    t = t.withColumn("_run", F.sum(F.col("_begin").cast("int")).over(w)).where(F.col(label) != "O")
    runs = t.groupBy(record, F.col("_run").alias("run")).agg(F.first("_type").alias("type"), F.min(idx).alias("first"), F.max(idx).alias("last"), F.max(F.col("_orphan").cast("int")).alias("repaired"))
    return runs if repair else runs.where("repaired = 0")


def bio_labels(tokens: DataFrame, spans: DataFrame, record: str = "record") -> DataFrame:
    """(record, idx, label, mask) of tokens (record, idx, start, end) under spans (record, start, end, type).

    A token of no width or across a span's border is masked; the join is by record, then by overlap."""
    s = spans.select(F.col(record), F.col("start").alias("s"), F.col("end").alias("e"), "type")
    j = tokens.join(s, (tokens[record] == s[record]) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s")), "left").drop(s[record])
    inside = (F.col("start") >= F.col("s")) & (F.col("end") <= F.col("e"))
    w = Window.partitionBy(record).orderBy("idx")
    same = F.coalesce((F.lag("s").over(w) == F.col("s")) & (F.lag("e").over(w) == F.col("e")), F.lit(False))
    j = j.withColumn("_go", same)
    mask = (F.col("start") == F.col("end")) | (F.col("s").isNotNull() & ~inside)
    label = F.when(mask, None).when(F.col("s").isNull(), F.lit("O")).otherwise(F.concat(F.when(F.col("_go"), F.lit("I-")).otherwise(F.lit("B-")), F.col("type")))
    return j.select(record, "idx", label.alias("label"), F.coalesce(mask, F.lit(False)).alias("masked"))


def canonical(spans: Column, type_map: dict[str, str]) -> Column:
    """Spans with mapped types, sorted by start."""
    mapped = lambda t: F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in type_map.items()], t)
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mapped(s["type"]).alias("type"))))


def span_errors(spans: Column, text: Column) -> Column:
    """What is wrong with sorted spans, or null."""
    bad_range = F.exists(spans, lambda s: (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.length(text)))
    untyped = F.exists(spans, lambda s: s["type"].isNull() | (s["type"] == ""))
    overlap = F.exists(F.zip_with(spans, F.slice(spans, 2, F.size(spans)), lambda a, b: b["start"] < a["end"]), lambda x: x)
    return F.when(bad_range, "range").when(untyped, "type").when(F.coalesce(overlap, F.lit(False)), "overlap")


def route(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their reason."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def rebuilt_text(tokens: Column, blanks: Column) -> Column:
    return F.array_join(F.zip_with(tokens, blanks, lambda t, b: F.concat(t, F.when(b, " ").otherwise(""))), "")


def running_offsets(tokens: Column, blanks: Column) -> Column:
    """Where each token starts, from the lengths before it."""
    sizes = F.zip_with(tokens, blanks, lambda t, b: F.length(t) + F.when(b, 1).otherwise(0))
    return F.aggregate(sizes, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")), lambda s, x: F.struct(F.concat(s["at"], F.array(s["n"])).alias("at"), (s["n"] + x).alias("n")), lambda s: s["at"])


def windows(lengths: Column, budget: int) -> Column:
    """Whole-token windows of at most ``budget``: array<struct<first,last,size>>; a longer token is a window of its own, cut to the budget."""
    start = F.struct(F.array().cast("array<struct<first:int,last:int,size:int>>").alias("done"), F.lit(0).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("size"))

    def step(s, n):
        n = F.least(n.cast("int"), F.lit(budget))
        full = (s["size"] + n > budget) & (s["last"] >= s["first"])
        done = F.when(full, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"), s["size"].alias("size"))))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(full, s["last"] + 1).otherwise(s["first"]).cast("int").alias("first"), (s["last"] + 1).cast("int").alias("last"), F.when(full, n).otherwise(s["size"] + n).cast("int").alias("size"))

    end = lambda s: F.when(s["last"] >= s["first"], F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"), s["size"].alias("size"))))).otherwise(s["done"])
    return F.aggregate(lengths, start, step, end)


def window_pieces(pieces: Column, budget: int, unknown: int = 0) -> tuple[Column, Column]:
    """Of a document's subwords by token (array<array<int>>): what of each token goes into windows, and its ledger.

    A token of more than ``budget`` subwords keeps its first ``(budget + 1) / 2`` and its last, so that ``budget`` are left; one
    without subwords is ``unknown``. The ledger has struct<token, subwords, head, tail, discarded, unknown> of each token."""
    head, tail = (budget + 1) // 2, budget // 2
    n = F.size
    kept = F.transform(pieces, lambda p: F.when(n(p) == 0, F.array(F.lit(unknown))).when(n(p) > budget, F.concat(F.slice(p, 1, head), F.slice(p, n(p) - tail + 1, F.lit(tail)))).otherwise(p))
    long = lambda p: n(p) > budget
    ledger = F.transform(pieces, lambda p, i: F.struct(i.alias("token"), n(p).alias("subwords"), F.when(long(p), head).otherwise(n(p)).alias("head"), F.when(long(p), tail).otherwise(0).alias("tail"), F.greatest(n(p) - budget, F.lit(0)).alias("discarded"), (n(p) == 0).alias("unknown")))
    return kept, ledger


def token_windows(docs: DataFrame, pieces: str, budget: int, unknown: int = 0) -> DataFrame:
    """``docs`` with ``windows`` and ``ledger``: array<struct<first, last, ids, words>> of whole tokens, at most ``budget`` subwords each.

    ``words`` has, beside each subword, its token's place in the document if it is the token's first, else -1, so that each
    token is scored at exactly one place. Documents that break this rule are refused as they go by; an empty one has no window."""
    kept, ledger = window_pieces(F.col(pieces), budget, unknown)
    j = docs.withColumn("_kept", kept).withColumn("_w", windows(F.transform("_kept", lambda p: F.size(p)), budget))
    part = lambda w: F.slice("_kept", w["first"] + 1, w["last"] - w["first"] + 1)
    words = lambda w: F.flatten(F.transform(part(w), lambda p, i: F.concat(F.array(w["first"] + i), F.array_repeat(F.lit(-1), F.size(p) - 1))))
    made = F.transform("_w", lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last"), F.flatten(part(w)).alias("ids"), words(w).alias("words")))
    j = j.withColumn("windows", made)
    scored = F.filter(F.flatten(F.transform("windows", lambda w: w["words"])), lambda i: i >= 0)
    tokens = F.size(pieces)
    once = (scored == F.when(tokens > 0, F.sequence(F.lit(0), tokens - 1)).otherwise(F.array().cast("array<int>"))) & ~F.exists("windows", lambda w: F.size(w["ids"]) > budget)
    checked = F.when(once, F.col("windows")).otherwise(F.raise_error(F.lit("a token is not scored exactly once")).cast("array<struct<first:int,last:int,ids:array<int>,words:array<int>>>"))
    return j.withColumns({"windows": checked, "ledger": ledger}).drop("_kept", "_w")


def window_coverage(windowed: DataFrame) -> DataFrame:
    """One row: documents, windows, tokens, the oversized and unknown among them, and subwords in windows and discarded."""
    over = F.filter("ledger", lambda t: t["discarded"] > 0)
    total = lambda f: F.coalesce(F.sum(F.aggregate("ledger", F.lit(0).cast("long"), lambda s, t: s + f(t))), F.lit(0))
    return windowed.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size("windows")), F.lit(0)).alias("windows"), F.coalesce(F.sum(F.size("ledger")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.size(over)), F.lit(0)).alias("oversized"), total(lambda t: t["unknown"].cast("long")).alias("unknown"),
        total(lambda t: t["head"].cast("long") + t["tail"] + t["unknown"].cast("long")).alias("retained_subwords"), total(lambda t: t["discarded"].cast("long")).alias("discarded_subwords"))


def match_spans(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of both sides, each once, with tp, fp and fn; a null in the keys matches nothing.

    Both sides go through one aggregate of a flag each, so a span is shuffled once and the sides are not joined."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    side = lambda df, g: df.select(*keys, F.lit(g).alias("_g"), F.lit(1 - g).alias("_p"), F.when(null, g).alias("_null"))
    m = side(gold, 1).unionByName(side(predicted, 0)).groupBy(*keys, "_null").agg(F.max("_g").alias("_g"), F.max("_p").alias("_p"))
    return m.select(*keys, (F.col("_g") * F.col("_p")).alias("tp"), (1 - F.col("_g")).alias("fp"), (1 - F.col("_p")).alias("fn"))


def prf(matched: DataFrame, by: list[str], empty_recall_null: bool = False) -> DataFrame:
    """Precision, recall and F1 over grouping columns; zero where a denominator is, or null recall without gold."""
    agg = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    g = (matched.groupBy(*by).agg(*agg) if by else matched.agg(*agg)).fillna(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    none = F.lit(None).cast("double") if empty_recall_null else F.lit(0.0)
    return g.withColumns({"precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(none), "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)})


# Look-alike letters, full-width symbols and digit words.
LOOKALIKE = ("aeo", "аео")
FULLWIDTH = ("@.-", "＠．－")
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
ATTACKS = ("character_substitution", "separator_insertion", "whitespace", "symbol_replacement", "email_obfuscation", "phone_formatting", "digit_words", "case", "token_splitting")


def attacked(value: Column, kind: Column, attack: str) -> Column:
    """A span's value under one obfuscation; unchanged where the attack doesn't apply to its type."""
    if attack == "character_substitution":
        return F.translate(value, *LOOKALIKE)
    if attack in ("separator_insertion", "token_splitting"):
        return F.array_join(F.filter(F.split(value, ""), lambda c: c != ""), "​" if attack == "separator_insertion" else " ")
    if attack == "whitespace":
        return F.replace(value, F.lit(" "), F.lit("  "))
    if attack == "symbol_replacement":
        return F.translate(value, *FULLWIDTH)
    if attack == "email_obfuscation":
        return F.when(F.contains(kind, F.lit("EMAIL")), F.replace(F.replace(value, F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" [dot] "))).otherwise(value)
    if attack == "phone_formatting":
        digits = F.regexp_replace(value, r"[^0-9]", "")
        return F.when(F.contains(kind, F.lit("PHONE")), F.concat(F.when(value.startswith("+"), "+").otherwise(""), F.trim(F.regexp_replace(digits, r"(\d{1,3})", "$1 ")))).otherwise(value)
    if attack == "digit_words":
        out = value
        for i, w in enumerate(DIGITS):
            out = F.replace(out, F.lit(str(i)), F.lit(f" {w} "))
        return F.trim(out)
    if attack == "case":
        lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        secret = F.lit(False)
        for k in ("PASSWORD", "KEY", "TOKEN", "PIN"):
            secret = secret | F.contains(kind, F.lit(k))
        return F.when(secret, value).otherwise(F.translate(value, lower + upper, upper + lower))
    raise ValueError(f"unknown attack {attack}")


def pattern_spans(text: Column, pattern: str, kind: str) -> Column:
    """Spans of every match of a pattern that doesn't look around itself.

    A match lies where its value first occurs after the match before: an earlier place would have matched itself."""
    start = F.struct(F.array().cast(SPAN).alias("spans"), F.lit(0).alias("at"))

    def step(acc, v):
        at = F.call_function("locate", v, text, acc["at"] + 1) - 1
        span = F.struct(at.alias("start"), (at + F.length(v)).alias("end"), F.lit(kind).alias("type"))
        return F.struct(F.concat(acc["spans"], F.array(span)).cast(SPAN).alias("spans"), (at + F.length(v)).alias("at"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), start, step, lambda acc: acc["spans"])


def attack_records(df: DataFrame, id_col: str, text_col: str, spans_col: str, attacks=ATTACKS) -> DataFrame:
    """A row for each record and attack that changes it: (id, parent_id, attack, text, spans, parent_spans, entity_changed). Spans are sorted and don't overlap."""
    rows = df.select(F.col(id_col).alias("parent_id"), F.col(text_col).alias("t"), F.col(spans_col).alias("s"), F.explode(F.array(*map(F.lit, attacks))).alias("attack"))

    def value(s):
        v = F.substring(F.col("t"), s["start"] + 1, s["end"] - s["start"])
        return F.coalesce(*[F.when(F.col("attack") == a, attacked(v, s["type"], a)) for a in attacks])

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"), F.array().cast("array<boolean>").alias("changed"))

    def step(acc, s):
        new = value(s)
        text = F.concat(acc["text"], F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"]))
        span = F.struct(F.length(text).alias("start"), (F.length(text) + F.length(new)).alias("end"), s["type"].alias("type"))
        return F.struct(F.concat(text, new).alias("text"), s["end"].alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"), F.concat(acc["changed"], F.array(new != F.substring(F.col("t"), s["start"] + 1, s["end"] - s["start"]))).alias("changed"))

    done = rows.withColumn("r", F.aggregate("s", start, step)).where(F.exists("r.changed", lambda c: c))
    text = F.concat(F.col("r.text"), F.expr("substring(t, r.at + 1)"))
    return done.select(F.substring(F.sha2(F.concat_ws("\u0001", F.col("parent_id").cast("string"), "attack"), 256), 1, 24).alias("record_id"), "parent_id", "attack", text.alias("text"), F.col("r.spans").alias("spans"), F.col("s").alias("parent_spans"), F.col("r.changed").alias("entity_changed"))


def attack_scores(attacked: DataFrame, detected: Column, attacks=ATTACKS) -> DataFrame:
    """Of each attack, over rows of ``attack_records`` whose clean spans were all found: strict scores of the spans
    ``detected`` in the new text, the changed entities and those no longer found. The clean F1 is 1, of all rows and of the pairs."""
    found = lambda s: F.array_contains(F.col("_found"), s)
    lost = F.filter(F.zip_with("spans", "entity_changed", lambda s, c: c & ~found(s)), lambda x: x)
    rows = attacked.withColumn("_found", detected.cast(SPAN)).select("attack", F.size(F.filter("spans", found)).alias("tp"), F.size("spans").alias("gold"), F.size("_found").alias("found"), F.size(F.filter("entity_changed", lambda c: c)).alias("eligible"), F.size(lost).alias("lost"))
    n = [F.count(F.lit(1)).alias("records"), F.sum("tp").alias("tp"), F.sum(F.col("found") - F.col("tp")).alias("fp"), F.sum(F.col("gold") - F.col("tp")).alias("fn"), F.sum("eligible").alias("eligible"), F.sum("lost").alias("lost")]
    sums = rows.groupBy("attack").agg(*n).withColumn("f1", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))
    names = attacked.sparkSession.createDataFrame([(a,) for a in attacks], "attack string")
    #: one row an attack
    j = names.join(F.broadcast(sums), "attack", "left")
    status = F.when(F.col("records").isNull(), "no_applicable_entities").otherwise("scored")
    return j.select("attack", status.alias("status"), "records", "tp", "fp", "fn", "f1", "eligible", "lost", (F.col("lost") / F.col("eligible")).alias("success_rate"), (1 - F.col("f1")).alias("degradation"))
