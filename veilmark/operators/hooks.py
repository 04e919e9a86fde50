"""Places where a user's own code takes part: observers of stages, encoders, policy evaluators, extractors of sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veilmark.functions.text import filled


class StageObserver:
    """Metrics of stages, taken while their rows go by on the way to a sink; what is observed never changes the rows.

    ``callback(stage, metrics)`` is called for each stage by ``report``; its failures are kept as text and do no harm."""

    def __init__(self, callback: Callable[[str, dict], None] | None = None):
        self.callback = callback
        self.seen: dict[str, Observation] = {}
        self.failures: dict[str, str] = {}

    def watch(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """``df`` as it is; ``metrics`` are aggregates by name, the number of rows is always one."""
        if stage in self.seen:
            raise ValueError(f"stage {stage} is watched already")
        self.seen[stage] = Observation(f"stage {stage} {id(self)}")
        return df.observe(self.seen[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])

    def report(self) -> dict[str, dict]:
        """The metrics of all stages; to be called when an action has run over them."""
        out = {stage: dict(o.get) for stage, o in self.seen.items()}
        for stage, metrics in out.items() if self.callback else ():
            try:
                self.callback(stage, dict(metrics))
            except Exception as e:  # noqa: BLE001  a user's code
                self.failures[stage] = repr(e)
        return out


def encode_texts(df: DataFrame, load: Callable[[], Callable[[list[str]], list]], column: str, text_col: str = "normalized_text", batch: int = 64) -> DataFrame:
    """``df`` with array<float> vectors of a user's encoder.

    ``load`` is called once in each task and gives a function of at most ``batch`` texts; missing texts are empty ones."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for t in texts:
            vectors = [v for lo in range(0, len(t), batch) for v in encode(t.iloc[lo : lo + batch].tolist())]
            yield pd.Series([[float(x) for x in v] for v in vectors], index=t.index, dtype=object)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(column, F.pandas_udf(run, "array<float>")(filled(text_col)))


#: What an annotator says of a text: entities as (text, label), and of each token (token, relation, head, is it punctuation).
Annotated = tuple[list[tuple[str, str]], list[tuple[str, str, str, bool]]]
ANNOTATION = "struct<entities: array<struct<text: string, label: string>>, dependencies: array<struct<token: string, relation: string, head: string>>, error: string>"


def annotate_texts(df: DataFrame, load: Callable[[], Callable[[list[str]], list]], column: str = "annotation", text_col: str = "normalized_text", batch: int = 64, dependencies: int = 50) -> DataFrame:
    """``df`` with what a user's model finds in each text: entities and the first ``dependencies`` triples that are no punctuation.

    ``load`` is called once in each task and gives a function of at most ``batch`` texts, which returns an ``Annotated`` for
    each. Where it fails on a batch, its texts are tried one by one; one that fails still has no entities, no dependencies and
    the reason in ``error``, and the job goes on. The text alone is sent to Python; missing texts are empty ones."""
    entity = pa.struct([("text", pa.string()), ("label", pa.string())])
    triple = pa.struct([("token", pa.string()), ("relation", pa.string()), ("head", pa.string())])

    def safely(annotate, texts: list[str]) -> list:
        try:
            out = annotate(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} annotations of {len(texts)} texts")
            return [(*a, None) for a in out]
        except Exception as e:  # noqa: BLE001  a user's code
            if len(texts) == 1:
                return [([], [], f"{type(e).__name__}: {e}")]
            return [x for t in texts for x in safely(annotate, [t])]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        annotate = load()
        for texts in batches:
            found = [x for lo in range(0, len(texts), batch) for x in safely(annotate, texts.slice(lo, batch).to_pylist())]
            entities = pa.array([[{"text": t, "label": k} for t, k in e] for e, _, _ in found], pa.list_(entity))
            shown = [[{"token": t, "relation": r, "head": h} for t, r, h, mark in d if not mark][:dependencies] for _, d, _ in found]
            yield pa.StructArray.from_arrays([entities, pa.array(shown, pa.list_(triple)), pa.array([e for *_, e in found], pa.string())], names=["entities", "dependencies", "error"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(column, F.arrow_udf(run, ANNOTATION)(filled(text_col)))


def evaluate_policies(cases: DataFrame, policies: DataFrame, evaluator: Callable[..., pd.Series], inputs: list[str], kind: str, out: str = "observation", most: int = 1000) -> DataFrame:
    """Every case under every policy, with what the user's ``evaluator`` says of the columns ``inputs``, batch by batch.

    The policies are counted and refused beyond ``most``; they go to the cases, which stay where they are."""
    if (n := policies.count()) > most:
        raise ValueError(f"{n} policies, more than {most}")
    return cases.crossJoin(F.broadcast(policies)).withColumn(out, F.pandas_udf(evaluator, kind)(*[F.col(c) for c in inputs]))


class Extractors:
    """Functions from a source's table to (query_text, context_text, domain), by source."""

    def __init__(self):
        self.known: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, source: str):
        def add(f: Callable[[DataFrame], DataFrame]):
            if source in self.known:
                raise ValueError(f"there is an extractor for {source}")
            self.known[source] = f
            return f

        return add

    def extract(self, tables: dict[str, DataFrame]) -> DataFrame:
        """The records of all tables under one schema, tagged with their source; a source without an extractor is an error."""
        if missing := sorted(set(tables) - set(self.known)):
            raise KeyError(f"no extractor for {missing}")
        out = None
        for source, table in tables.items():
            made = self.known[source](table).select("query_text", "context_text", "domain", F.lit(source).alias("source_dataset"))
            out = made if out is None else out.unionByName(made)
        return out


def stage_trace(df: DataFrame, id_col: str, column: str, stages: dict[str, Callable[[DataFrame], DataFrame]], most: int = 1000) -> DataFrame:
    """(id, step, stage, before, after) of ``column`` of a small batch, through stages that keep ids; dropped rows have no after.

    A batch of more than ``most`` rows is refused: a trace is to be read."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to trace")
    out, now = None, df
    for i, (name, stage) in enumerate(stages.items()):
        then = stage(now)
        b = now.select(F.col(id_col).alias("_id"), F.col(column).cast("string").alias("before"))
        a = then.select(F.col(id_col).alias("_after_id"), F.col(column).cast("string").alias("after"))
        rows = b.join(a.hint("merge"), F.col("_id").eqNullSafe(F.col("_after_id")), "left").select(F.col("_id").alias(id_col), F.lit(i).alias("step"), F.lit(name).alias("stage"), "before", "after")
        out, now = rows if out is None else out.unionByName(rows), then
    return out
