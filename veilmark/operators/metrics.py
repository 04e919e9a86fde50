"""Scores of classifiers, calibration and uncertainty, each from one or two aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.probs import entropy
from veilmark.operators.corpus import running_sum
from veilmark.operators.skew import look_up
from veilmark.scratch import cut


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def single_label(df: DataFrame, y: str, p: str) -> DataFrame:
    """accuracy, macro_f1 and weighted_f1 over the classes seen on either side; 0 where nothing is to divide by."""
    c = cut(confusion(df, y, p))
    of_y = c.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    of_p = c.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("guessed"))
    each = of_y.join(of_p, "c", "full").fillna(0)
    f1 = F.when(F.col("support") + F.col("guessed") > 0, 2 * F.col("tp") / (F.col("support") + F.col("guessed"))).otherwise(0.0)
    n = F.sum("support")
    return each.agg((F.sum("tp") / n).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("support")) / n).alias("weighted_f1"))


def multi_label(df: DataFrame, truth: str, probs: str, names: list[str], threshold: float = 0.5) -> DataFrame:
    """(category, tp, fp, fn, f1) with rows micro and macro; both sides count from ``threshold`` on."""
    long = df.select(F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(probs).alias("p"))).alias("i", "x"))
    t, p = F.col("x.t") >= threshold, F.col("x.p") >= threshold
    each = cut(long.groupBy(F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("category")).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")))
    f1 = lambda a, b, c: F.when(2 * a + b + c > 0, 2 * a / (2 * a + b + c)).otherwise(0.0)
    scored = each.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    sums = [F.sum(x).alias(x) for x in ("tp", "fp", "fn")]
    micro = each.agg(*sums).select(F.lit("micro").alias("category"), "tp", "fp", "fn", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
    macro = scored.agg(*sums, F.avg("f1").alias("f1")).select(F.lit("macro").alias("category"), "tp", "fp", "fn", "f1")
    return scored.unionByName(micro).unionByName(macro)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc by the rank sum with average ranks on ties, from one row a distinct score; null when one class is missing."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = running_sum(by, ["s"], "n").withColumn("rank", F.col("running") - F.col("n") + (F.col("n") + 1) / 2.0)
    p, n = F.sum("pos"), F.sum("n") - F.sum("pos")
    return ranked.agg(F.when((p > 0) & (n > 0), (F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2.0) / (p * n)).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum over falling thresholds of precision times the recall gained; null without positives."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    falling = running_sum(by.withColumn("_s", -F.col("s")), ["_s"], "pos", "tp")
    r = running_sum(falling, ["_s"], "n", "all")
    return r.agg(F.when(F.sum("pos") > 0, F.sum(F.col("tp") / F.col("all") * F.col("pos")) / F.sum("pos")).alias("ap"))


def ece_bins(df: DataFrame, confidence: Column, correct: Column, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(…, bin, n, confidence, accuracy, gap) of uniform bins, the last closed; empty bins are kept for each group."""
    by = by or []
    b = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    g = df.select(*by, b.alias("bin"), confidence.alias("c"), correct.cast("double").alias("a")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("confidence"), F.avg("a").alias("accuracy"))
    grid = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    j = grid.join(g.hint("merge"), [*by, "bin"], "left")
    return j.select(*by, "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce(F.abs(F.col("confidence") - F.col("accuracy")), F.lit(0.0)).alias("gap"))


def ece(df: DataFrame, confidence: Column, correct: Column, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error (of each group)."""
    by = by or []
    b = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    g = df.select(*by, b.alias("bin"), confidence.alias("c"), correct.cast("double").alias("a")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.sum("a").alias("a"))
    value = (F.sum(F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece")
    return g.groupBy(*by).agg(value) if by else g.agg(value)


def token_scores(df: DataFrame, probs: str, y: str) -> DataFrame:
    """nll and brier of class distributions."""
    p_y = F.greatest(F.col(probs)[F.col(y)], F.lit(1e-12))
    brier = F.aggregate(F.transform(probs, lambda x, i: F.pow(x - F.when(i == F.col(y), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda s, x: s + x)
    return df.agg(F.avg(-F.log(p_y)).alias("nll"), F.avg(brier).alias("brier"), F.count(F.lit(1)).alias("n"))


def risk_coverage(df: DataFrame, error: str, uncertainty: str, ties: list[str]) -> DataFrame:
    """(rank, risk): rows by rising uncertainty and the error rate up to each; running sums over range partitions."""
    rows = df.select(F.col(error).cast("int").alias("e"), F.col(uncertainty).alias("u"), *ties)
    return running_sum(rows, ["u", *ties], "e", "run", rank="rank").select("rank", (F.col("run") / F.col("rank")).alias("risk"))


def aurc(df: DataFrame, error: str, uncertainty: str, ties: list[str]) -> DataFrame:
    """Mean over coverage of the running error rate, rows by rising uncertainty."""
    return risk_coverage(df, error, uncertainty, ties).agg(F.avg("risk").alias("aurc"))


def risk_coverage_curve(df: DataFrame, error: str, uncertainty: str, ties: list[str], points: int = 100) -> DataFrame:
    """(point, coverage, risk) at ``points`` even coverages, the last of which covers all rows."""
    rows = cut(risk_coverage(df, error, uncertainty, ties))
    n = rows.agg(F.max("rank")).first()[0] or 0
    if not n:
        return rows.select(F.lit(0).alias("point"), F.lit(0.0).alias("coverage"), "risk").limit(0)
    #: ``points`` rows
    at = df.sparkSession.createDataFrame([(i, -(-n * i // points)) for i in range(1, points + 1)], "point int, _rank long")
    return rows.join(F.broadcast(at), F.col("rank") == F.col("_rank")).select("point", (F.col("rank") / n).alias("coverage"), "risk")


def by_correctness(df: DataFrame, correct: Column, measures: dict[str, Column]) -> DataFrame:
    """Means of the measures for correct and incorrect rows; null for a group without rows."""
    g = df.groupBy(F.when(correct, "correct").otherwise("incorrect").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(n) for n, c in measures.items()])
    both = df.sparkSession.createDataFrame([("correct",), ("incorrect",)], "outcome string")
    return both.join(g, "outcome", "left").fillna(0, ["n"])


def draws_summary(draws: DataFrame, keys: list[str], probs: str = "probs") -> DataFrame:
    """(keys, mean, variance, predictive_entropy, expected_entropy, mutual_information) over passes; variance is the population's.

    All draws have as many classes as the first, so one aggregate takes all means and variances."""
    k = (draws.select(F.size(probs)).first() or [0])[0]
    p = F.col(probs)
    stats = draws.groupBy(*keys).agg(F.array(*[F.avg(p[i]) for i in range(k)]).alias("mean"), F.array(*[F.var_pop(p[i]) for i in range(k)]).alias("variance"), F.avg(entropy(p)).alias("expected_entropy"))
    out = stats.withColumn("predictive_entropy", entropy(F.col("mean")))
    return out.withColumn("mutual_information", F.col("predictive_entropy") - F.col("expected_entropy")).select(*keys, "mean", "variance", "expected_entropy", "predictive_entropy", "mutual_information")


def variation_ratio(draws: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """1 minus the share of the passes' most frequent choice."""
    c = draws.groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*keys).agg((1 - F.max("n") / F.sum("n")).alias("variation_ratio"))


def budgets(draws: DataFrame, pass_col: str, sizes: list[int]) -> DataFrame:
    """The first t passes for each t of ``sizes``."""
    return draws.withColumn("budget", F.explode(F.array(*map(F.lit, sizes)))).where(F.col(pass_col) < F.col("budget"))


def log_mixture_nll(draws: DataFrame, keys: list[str], p_true: str) -> DataFrame:
    """Mean over units of minus the log of the passes' mean probability of the truth."""
    m = draws.groupBy(*keys).agg(F.avg(p_true).alias("m"))
    return m.agg(F.avg(-F.log(F.greatest("m", F.lit(1e-12)))).alias("nll"))


def fit_temperature(df: DataFrame, logits: str, y: str, span: float = 3.0, candidates: int = 9, tolerance: float = 1e-4) -> float:
    """The temperature of least mean NLL: each round one aggregate takes the NLL at a few log-temperatures around the best.

    Never worse than 1, which it is for no rows."""
    top = F.array_max(logits)

    def nll(t: float) -> Column:
        return F.avg((top - F.col(logits)[F.col(y)]) / t + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp((x - top) / t))))

    centre, step = 0.0, span
    best = df.agg(nll(1.0).alias("x")).first()[0]
    if best is None:
        return 1.0
    chosen = 0.0
    while step > tolerance:
        at = [centre + step * (2 * i / (candidates - 1) - 1) for i in range(candidates)]
        got = df.agg(*[nll(math.exp(t)).alias(f"c{i}") for i, t in enumerate(at)]).first()
        i = min(range(candidates), key=lambda k: got[k])
        if got[i] < best:
            best, chosen = got[i], at[i]
        centre, step = at[i], step * 2.5 / (candidates - 1)
    return math.exp(chosen)


def rank_stability(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation with average ranks on ties."""
    def ranks(c: str) -> DataFrame:
        by = running_sum(df.groupBy(F.col(c).alias("s")).agg(F.count(F.lit(1)).alias("n")), ["s"], "n")
        return by.select(F.col("s").alias(c), "n", (F.col("running") - F.col("n") + (F.col("n") + 1) / 2.0).alias(f"rank_{c}"))

    j = look_up(look_up(df.select(a, b), ranks(a), [a], "n", b), ranks(b), [b], "n", a)
    return j.agg(F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"))


def metric_changes(before: DataFrame, after: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, before, after, change, within): differences of two metric tables, null where either is missing."""
    j = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")
    change = F.col("after") - F.col("before")
    return j.select(key, "before", "after", change.alias("change"), (F.abs(change) <= tolerance).alias("within"))


def soft_cross_entropy(df: DataFrame, targets: str, logits: str) -> DataFrame:
    top = F.array_max(logits)
    norm = F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    each = F.aggregate(F.zip_with(targets, logits, lambda t, x: t * (norm - x)), F.lit(0.0), lambda s, x: s + x)
    return df.agg(F.avg(each).alias("loss"))


def posterior_diagnostics(df: DataFrame, probs: str, by: str, uncertain: float = 0.6) -> DataFrame:
    """(group, n, mean_entropy, mean_max_confidence, n_uncertain) of all rows and of each group, from one pass."""
    p = F.col(probs)
    g = df.select(F.col(by).alias("grp"), entropy(p).alias("h"), F.array_max(p).alias("c")).groupingSets([["grp"], []], "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("mean_entropy"), F.avg("c").alias("mean_max_confidence"), F.count_if(F.col("c") < uncertain).alias("n_uncertain"), F.grouping("grp").alias("g"))
    return g.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("grp")).alias("grp"), "n", "mean_entropy", "mean_max_confidence", "n_uncertain")




def masked_agreement(df: DataFrame, probs: str, y: str, observed: Column) -> DataFrame:
    """observed, agreement and loss (cross-entropy) over observed rows only; null where none is."""
    p_y = F.greatest(F.col(probs)[F.col(y)], F.lit(1e-12))
    best = F.array_position(F.col(probs), F.array_max(probs)) - 1
    seen = lambda c: F.avg(F.when(observed, c))
    return df.agg(F.count_if(observed).alias("observed"), seen((best == F.col(y)).cast("int")).alias("agreement"), seen(-F.log(p_y)).alias("loss"))


def budget_stability(draws: DataFrame, keys: list[str], pass_col: str, probs: str, sizes: list[int]) -> DataFrame:
    """(budget, delta, agreement): of the first t passes' means against those of the largest budget, the mean absolute difference
    of probabilities and how often both have the same first class."""
    k = (draws.select(F.size(probs)).first() or [0])[0]
    p = F.col(probs)
    most = max(sizes)
    #: all budgets in one aggregate a unit: no draw is copied and nothing is joined
    means = draws.groupBy(*keys).agg(*[F.array(*[F.avg(F.when(F.col(pass_col) < t, p[i])) for i in range(k)]).alias(f"m{t}") for t in sizes])
    gap = lambda t: F.aggregate(F.zip_with(f"m{t}", f"m{most}", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / k
    first = lambda t: F.array_position(F.col(f"m{t}"), F.array_max(f"m{t}"))
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(t).alias("budget"), gap(t).alias("delta"), (first(t) == first(most)).cast("int").alias("same")) for t in sizes])).alias("x")).select("x.*")
    return rows.groupBy("budget").agg(F.avg("delta").alias("delta"), F.avg("same").alias("agreement"))
