"""The label model: EM over vote patterns.

A posterior depends on a row's votes alone, so EM runs on the table of distinct vote patterns with their counts, and the
posteriors are joined back to the rows by pattern. A round is one aggregate; only the functions' accuracies reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.probs import argmax, safe_normalised
from veilmark.operators.skew import join_counted
from veilmark.scratch import cut

ROUNDS, START, LOW, HIGH, SILENT = 8, 0.7, 0.05, 0.99, 0.5


def posterior(votes: str, theta: list[float], k: int, mu: list[float] | None = None) -> Column:
    """P(class | votes): a vote is right with its function's accuracy, else spread over the other classes."""
    mu = mu or [1.0 / k] * k

    def right(j: int, c: int) -> str:
        wrong = (1.0 - theta[j]) / max(k - 1, 1)
        return f"CASE WHEN `{votes}`[{j}] < 0 THEN 1D WHEN `{votes}`[{j}] = {c} THEN {theta[j]!r}D ELSE {wrong!r}D END"

    # one expression as text: thousands of nodes made one by one from Python take longer than the job
    joint = ", ".join(" * ".join([f"{mu[c]!r}D", *(right(j, c) for j in range(len(theta)))]) for c in range(k))
    return safe_normalised(F.expr(f"array({joint})"), k)


def fit(rows: DataFrame, votes: str, m: int, k: int, rounds: int = ROUNDS, update_mu: bool = False) -> tuple[DataFrame, dict]:
    """(patterns with their posteriors, {theta, mu, theta_used}). Posteriors are those of the last E-step, before the last M-step.

    Only sums reach the driver, two a function and one a class in each round."""
    patterns = cut(rows.groupBy(F.col(votes).alias("votes")).agg(F.count(F.lit(1)).alias("n")))
    theta, mu = [START] * m, [1.0 / k] * k
    used = theta
    sums = [f"sum(CASE WHEN votes[{j}] >= 0 THEN n * p[votes[{j}]] END) AS s{j}" for j in range(m)] + [f"sum(CASE WHEN votes[{j}] >= 0 THEN n END) AS c{j}" for j in range(m)]
    sums += [f"sum(n * p[{c}]) AS m{c}" for c in range(k)] + ["sum(n) AS total"]
    for _ in range(max(1, rounds)):
        used, prior = theta, mu
        got = patterns.withColumn("p", posterior("votes", theta, k, mu)).selectExpr(*sums).first()
        theta = [min(HIGH, max(LOW, got[f"s{j}"] / got[f"c{j}"])) if got[f"c{j}"] else SILENT for j in range(m)]
        if update_mu and got["total"]:
            mu = [got[f"m{c}"] / got["total"] for c in range(k)]
    return patterns.withColumn("probabilities", posterior("votes", used, k, prior)), {"theta": theta, "mu": mu, "theta_used": used}


def apply(rows: DataFrame, votes: str, patterns: DataFrame) -> DataFrame:
    """``rows`` with probabilities, joined by vote pattern; frequent patterns go through a broadcast."""
    total = patterns.agg(F.sum("n")).first()[0] or 0
    keyed = rows.withColumn("votes_key", F.col(votes))
    table = cut(patterns.select(F.col("votes").alias("votes_key"), "probabilities", "n"))
    return join_counted(keyed, table, ["votes_key"], total, "n", rows.columns[0]).drop("votes_key")


def infer(rows: DataFrame, votes: str, theta: list[float], k: int) -> DataFrame:
    """``rows`` with posteriors from given accuracies, e.g. those of the train split."""
    return rows.withColumn("probabilities", posterior(votes, theta, k))


def empirical_accuracy(patterns: DataFrame, m: int) -> DataFrame:
    """(j, accuracy): how often a function's vote is the posterior's first largest class; 0.5 if it never votes."""
    best = argmax(F.col("probabilities"))
    long = patterns.select("n", best.alias("best"), F.posexplode("votes").alias("j", "v"))
    right = F.sum(F.when(F.col("v") >= 0, F.when(F.col("v") == F.col("best"), F.col("n")).otherwise(0)))
    cast = F.sum(F.when(F.col("v") >= 0, F.col("n")))
    return long.groupBy("j").agg(F.coalesce(right / cast, F.lit(SILENT)).alias("accuracy"))


def suppressed_classes(train: DataFrame, majority_probs: str, model_probs: str) -> DataFrame:
    """(class): those that are some row's majority class in train and no row's model class."""
    a = train.select(argmax(F.col(majority_probs)).alias("class")).distinct()
    return a.join(train.select(argmax(F.col(model_probs)).alias("class")).distinct(), "class", "left_anti")
