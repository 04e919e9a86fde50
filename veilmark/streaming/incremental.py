"""Incremental evidence and votes over arriving files; progress survives restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilmark.operators.corpus import clean_records
from veilmark.operators.evidence import add_evidence
from veilmark.operators.labeling import vote_matrix


def label(df: DataFrame, targets: list[str] | None = None, gazetteer: dict[str, str] | None = None) -> DataFrame:
    """Cleaning, evidence and votes, all stateless: the same for a batch and a stream."""
    return vote_matrix(add_evidence(clean_records(df, nfkc=False), gazetteer=gazetteer), targets)


def run(spark: SparkSession, source: str, sink: str, progress: str, schema: str, targets: list[str] | None = None, gazetteer: dict[str, str] | None = None) -> None:
    """Labels every file below ``source`` that ``progress`` doesn't know yet, then stops."""
    stream = label(spark.readStream.schema(schema).parquet(source), targets, gazetteer)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
