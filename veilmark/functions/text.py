"""Text scalars as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(c: Column | str) -> Column:
    """Missing becomes the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def collapsed(c: Column | str) -> Column:
    """Runs of Unicode white space become one blank, and none at the ends."""
    return F.trim(F.regexp_replace(filled(c), r"(?U)[\s\x1C-\x1F]+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def normalised(c: Column | str) -> Column:
    """NFKC; only texts that have a character beyond ASCII are sent to Python."""
    text = filled(c)
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfkc(F.when(~text.rlike(r"^\p{ASCII}*$"), text)))


def cleaned(c: Column | str, nfkc: bool = True) -> Column:
    return collapsed(normalised(c) if nfkc else c)


def folded(c: Column | str) -> Column:
    """Caseless key: lower case with the expansions that lower() leaves out."""
    return F.replace(F.lower(filled(c)), F.lit("ß"), F.lit("ss"))


def contains_any(c: Column, terms, word_boundary: bool = False) -> Column:
    """Whether any of the terms is a substring (or, with ``word_boundary``, a run of words) of ``c``."""
    quoted = "|".join(sorted(r"\Q" + t + r"\E" for t in terms))
    return c.rlike(rf"\b(?:{quoted})\b" if word_boundary else quoted)


def stable_id(*parts: Column | str, length: int = 64) -> Column:
    """Hex digest of the parts; the same row has the same id on every run."""
    digest = F.sha2(F.concat_ws("\u0001", *[filled(F.col(p).cast("string") if isinstance(p, str) else p.cast("string")) for p in parts]), 256)
    return F.substring(digest, 1, length)


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of the parts; 52 bits, so exact in a double."""
    return F.conv(F.substring(stable_id(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)
