"""A linear classifier on soft labels."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(df: DataFrame, probs: str, observed: str | None = None) -> DataFrame:
    """Each row once for each class, with the class as label and its probability as weight; the weighted log loss is then the
    soft cross-entropy. Rows that aren't observed are left out."""
    rows = df.where(F.col(observed)) if observed else df
    return rows.select("*", F.posexplode(probs).alias("label", "weight")).where("weight > 0").withColumn("label", F.col("label").cast("double"))


def fit(df: DataFrame, text: str, probs: str, observed: str | None = None, features: int = 1 << 14, regularisation: float = 0.01) -> PipelineModel:
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", regParam=regularisation, maxIter=30, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(expand(df, probs, observed))
