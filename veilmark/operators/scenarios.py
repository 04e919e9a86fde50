"""Controlled records from templates and lexicons, addressed by number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators.groups import representatives


@dataclass(frozen=True)
class Partition:
    """What one side of a benchmark is made of: templates (id, scenario, text with {slots}), a lexicon by slot, a marker."""

    name: str
    templates: list[tuple[str, str, str]]
    lexicon: dict[str, list[str]]
    marker: str


def overlaps(a: Partition, b: Partition) -> list[tuple[str, list[str]]]:
    """(kind, shared) of what both partitions have: texts of templates, words of each slot, the marker."""
    shared = [("templates", sorted({t[2] for t in a.templates} & {t[2] for t in b.templates}))]
    shared += [(f"lexicon {k}", sorted(set(a.lexicon[k]) & set(b.lexicon.get(k, [])))) for k in sorted(a.lexicon)]
    return [*shared, ("marker", [a.marker] if a.marker == b.marker else [])]


def refuse_overlap(a: Partition, b: Partition) -> None:
    if bad := [f"{kind}: {', '.join(found)}" for kind, found in overlaps(a, b) if found]:
        raise ValueError("partitions overlap in " + "; ".join(bad))


def generate(numbers: DataFrame, part: Partition, labels: DataFrame, number: str = "i") -> DataFrame:
    """A record for each number: (i, template_id, scenario, query_text, partition) and the scenario's ``labels``.

    Numbers begin at 0. Number i is read in mixed radix: its remainder by the number of templates names the template, and each slot takes the
    quotient's remainder by the size of its word list. ``{marker}`` is the partition's marker with the number. Texts that come
    again are given once, with their least number. Templates, word lists and labels are configuration."""
    t = numbers.sparkSession.createDataFrame([(k, *row) for k, row in enumerate(part.templates)], "_t int, template_id string, scenario string, _text string")
    i = F.col(number)
    n = len(part.templates)
    rows = numbers.select(i.cast("long").alias("i")).join(F.broadcast(t), F.pmod(F.col("i"), F.lit(n)) == F.col("_t"))
    text, at = F.col("_text"), F.floor(F.col("i") / n)
    for slot, words in part.lexicon.items():
        word = F.element_at(F.array(*map(F.lit, words)), (at % len(words)).cast("int") + 1)
        text = F.replace(text, F.lit("{" + slot + "}"), word)
    text = F.replace(text, F.lit("{marker}"), F.concat(F.lit(f"[{part.marker}_"), F.lpad(F.col("i").cast("string"), F.greatest(F.lit(5), F.length(F.col("i").cast("string"))), F.lit("0")), F.lit("]")))
    made = representatives(rows.select("i", "template_id", "scenario", text.alias("query_text")), F.col("query_text"), ["i"])
    return made.join(F.broadcast(labels), "scenario", "left").withColumn("partition", F.lit(part.name))
