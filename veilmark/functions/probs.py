"""Distributions held in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def argmax(a: Column) -> Column:
    """Index of the largest element, the first on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def entropy(a: Column, floor: float = 1e-12) -> Column:
    """Natural entropy, with elements held above ``floor``."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s - F.greatest(x, F.lit(floor)) * F.log(F.greatest(x, F.lit(floor))))


def normalised_entropy(a: Column) -> Column:
    return F.when(F.size(a) > 1, entropy(a) / F.log(F.size(a).cast("double"))).otherwise(F.lit(0.0))


def binary_entropy(p: Column, clip: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def softmax(a: Column, temperature: Column | float = 1.0) -> Column:
    t = F.greatest(temperature if isinstance(temperature, Column) else F.lit(float(temperature)), F.lit(1e-6))
    raised = F.transform(a, lambda x: F.exp((x - F.array_max(a)) / t))
    return F.transform(raised, lambda x: x / total(raised))


def sigmoid(x: Column, temperature: Column | float = 1.0) -> Column:
    t = F.greatest(temperature if isinstance(temperature, Column) else F.lit(float(temperature)), F.lit(1e-6))
    return 1 / (1 + F.exp(-x / t))


def log_rescaled(p: Column, temperature: float) -> Column:
    """Probabilities re-scaled by a temperature through their logs."""
    return softmax(F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-12)))), temperature)


def safe_normalised(a: Column, k: int) -> Column:
    """Elements over their sum, uniform where the sum is next to nothing or not a number."""
    s = total(a)
    return F.when((s > 1e-12) & ~F.isnan(s), F.transform(a, lambda x: x / s)).otherwise(F.array_repeat(F.lit(1.0 / k), k))


def multi_label_confidence(p: Column) -> Column:
    """Mean over labels of the larger of p and 1 - p."""
    return total(F.transform(p, lambda x: F.greatest(x, 1 - x))) / F.size(p)
