"""Pattern and entity evidence."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import Window

# The patterns by name, with the group whose text is a match.
PATTERNS = {
    "email": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0),
    "phone": (r"(?<!\d)(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)", 1),
    "money": (r"[$₹€£]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s?(?:USD|INR|EUR|GBP|dollars)\b", 0),
    "date": (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b", 0),
    "url": (r"https?://[^\s]+|www\.[^\s]+", 0),
    "account_number": (r"\b(?:AC|MRN|A/C)?-?\d{6,}\b", 0),
}
# Caseless patterns whose matches keep their offsets.
OFFSET_PATTERNS = {
    "email": r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ -]?)?(?:\(\d{3}\)|\d{3})[ -]\d{3}[ -]\d{4}\b",
    "identifier": r"\b(?:ssn|patient id|account number|account no|iban|mrn)\s*[:=#-]?\s*[A-Z0-9][A-Z0-9 -]{3,25}\b",
    "credential": r"\b(?:password|api[ _-]?key|secret|otp|pin)\s*(?:is|:|=)\s*\S+",
    "date": r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b",
    "medical_result": r"\b(?:hba1c|test results?|diagnos(?:is|ed)|blood sugar|symptoms?|prescription)\b",
    "personal_reference": r"\b(?:my|mine|our|i have|i am|i feel|my husband|my wife|my child)\b",
}
NAME_LIKE = r"\b[A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)?\b"
ENTITY = "array<struct<text:string,label:string>>"


def pattern_matches(text: Column, active: list[str] | None = None) -> Column:
    """map<name, distinct matches in order> of the patterns that hit; a match is its group, so a phone's country code."""
    found = [F.struct(F.lit(n).alias("key"), F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERNS[n][0]), F.lit(PATTERNS[n][1]))).alias("value")) for n in active or PATTERNS]
    return F.map_from_entries(F.filter(F.array(*found), lambda x: F.size(x["value"]) > 0))


def name_entities(text: Column) -> Column:
    """Distinct capitalised words and pairs, labelled PROPN_HEURISTIC."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME_LIKE), F.lit(0))), lambda x: F.struct(x.alias("text"), F.lit("PROPN_HEURISTIC").alias("label")))


def lookup_entities(text: Column, labels: dict[str, str]) -> Column:
    """Entities named by a prefix and a number, as a small gazetteer has them."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b(?:{'|'.join(labels)})[0-9]+"), F.lit(0)))
    label = lambda x: F.coalesce(*[F.when(x.startswith(p), F.lit(v)) for p, v in labels.items()])
    return F.transform(words, lambda x: F.struct(x.alias("text"), label(x).alias("label")))


def hits(name: str, matches: Column | str = "regex_matches") -> Column:
    return F.coalesce(F.map_contains_key(matches, F.lit(name)), F.lit(False))


def add_evidence(df: DataFrame, text_col: str = "normalized_text", gazetteer: dict[str, str] | None = None) -> DataFrame:
    """``df`` with regex_matches and entities."""
    entities = name_entities(F.col(text_col))
    if gazetteer:
        entities = F.concat(entities, lookup_entities(F.col(text_col), gazetteer))
    return df.withColumns({"regex_matches": pattern_matches(F.col(text_col)), "entities": entities})


#: Texts of a batch that are Python objects at once.
SLICE = 64
_SPAN = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[str, re.Pattern]]:
    return [(n, re.compile(p, re.I)) for n, p in OFFSET_PATTERNS.items()]


@F.arrow_udf(_SPAN)
def offset_matches(texts: pa.Array) -> pa.Array:
    """All caseless matches with code-point offsets, by pattern and start. ``SLICE`` texts at a time are Python objects."""
    parts = []
    for lo in range(0, len(texts), SLICE):
        names, found, starts, ends, upto = [], [], [], [], [0]
        for t in texts.slice(lo, SLICE).to_pylist():
            for n, p in _compiled() if t else ():
                for m in p.finditer(t):
                    names.append(n)
                    found.append(m.group())
                    starts.append(m.start())
                    ends.append(m.end())
            upto.append(len(names))
        structs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["name", "text", "start", "end"])
        parts.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), structs))
    return pa.concat_arrays(parts) if parts else pa.array([], to_arrow_type(_SPAN))


def baseline_spans(matches: Column, known: dict[str, str]) -> Column:
    """Spans of the patterns that stand for a known type, with confidence 1."""
    kept = F.filter(matches, lambda m: m["name"].isin(*known))
    kind = lambda m: F.coalesce(*[F.when(m["name"] == n, F.lit(t)) for n, t in known.items()])
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), kind(m).alias("type"), F.lit(1.0).alias("confidence")))


def annotate(df: DataFrame, annotator: Callable[[pd.Series], pd.Series], kind: str, column: str, text_col: str = "normalized_text", batch: int = SLICE) -> DataFrame:
    """``df`` with a column made by a user's model, ``batch`` texts at a time; the text alone is sent to it.

    The texts of a batch of Spark's stay in Arrow until their turn comes."""
    made = to_arrow_type(T._parse_datatype_string(kind))

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array(annotator(texts.slice(lo, batch).to_pandas()), made, from_pandas=True) for lo in range(0, len(texts), batch)]
        return pa.concat_arrays(parts) if parts else pa.array([], made)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(column, F.arrow_udf(run, kind)(F.col(text_col)))


def hashing_embedding(df: DataFrame, id_col: str, text_col: str, dims: int = 384) -> DataFrame:
    """(id, dim, value) of the L2-normalised sum of signed hashed words; dimensions without a word are left out."""
    words = df.select(id_col, F.explode(F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")).alias("word")).withColumn("h", F.sha2("word", 256))
    dim = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = words.groupBy(id_col, dim.alias("dim")).agg(F.sum(sign).alias("v")).where("v <> 0")
    #: at most ``dims`` rows an id
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_col)))
    return sums.select(id_col, "dim", (F.col("v") / norm).alias("value"))
