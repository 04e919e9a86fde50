"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source is expected ``target / source size`` times. Along the documents of a source, in an order that
puts sizes side by side, expected copies add up from one random start; a document is emitted once for each whole number
that the sum passes. The order is (size class, lot, size, id): lots are hashed from id and text so that no window holds more
than about ``LOT_ROWS`` rows of a source, whatever its share, and the sums before each lot come from the lots' totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilmark.scratch import cut

LOT_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from one row a source.

    Sources by code point, null last, weigh ``weights`` over and over and share the sum of all sizes; a target stops at
    ``most`` times its source's size and the rest goes to the others by weight. With the sources in order of ``most * size /
    weight``, those that stop are a prefix, so the level of the others is a ratio of running sums."""
    ranked = sizes.select(F.col(source).alias("source"), F.col(size).alias("source_size"), F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())).alias("rank"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    w = ranked.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns(
        {
            "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    #: the level that this source and all after it would reach; the first source under its cap sets it
    w = w.withColumn("level", F.col("left") / F.col("weights"))
    w = w.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("rank"), F.col("level")))).over(every)["level"]
    w = w.withColumn("set", level)
    target = F.when(F.col("set").isNull() | (F.col("set") * F.col("weight") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("set") * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def _draw(*parts) -> F.Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 1) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``copies``, how often the mix takes the row.

    Null texts have size 0; a null source is a source of its own, the last. Rows that repeat an id are rows of their own and
    ties are broken by a hash of the text, so reruns agree. A source without words takes its rows no times. Columns of these names in ``docs`` are
    replaced. An empty table gives no rows."""
    own = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c not in own]
    rows = docs.select(*kept).withColumn("size", F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD))).cast("long"))
    rows = rows.withColumns(
        {
            "_source": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")),
            "_class": F.length(F.bin("size")),
            "_lot_draw": _draw(F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(text_col).cast("string")),
        }
    )
    total = docs.count()
    n_lots = max(1, -(-total // LOT_ROWS))
    rows = rows.withColumn("_lot", F.floor(F.col("_lot_draw") * n_lots).cast("int"))
    #: a row for each lot of a size class and source; words are counted for these once, and once more for the rows
    lots = cut(rows.groupBy("_source", "_class", "_lot").agg(F.first(source_col, ignorenulls=True).alias("source"), F.sum("size").alias("_s"), F.count(F.lit(1)).alias("_rows")))
    sizes = lots.groupBy("_source").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("_s").alias("size"))
    lots = lots.drop("source", "_s")
    targets = source_targets(sizes, "source", "size", weights, most)
    lots = lots.withColumn("_before", F.sum("_rows").over(Window.partitionBy("_source").orderBy("_class", "_lot")) - F.col("_rows"))
    targets = targets.withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    lots = lots.join(targets.hint("shuffle_hash"), F.col("_source") == F.col("_s")).drop("_s")
    lots = lots.select(*[F.col(c).alias(f"_l{c}") for c in ("_source", "_class", "_lot")], "_before", "source_size", "target")
    order = Window.partitionBy("_source", "_class", "_lot").orderBy("size", F.col(id_col).asc_nulls_last(), F.xxhash64(text_col))
    rows = rows.withColumn("_rank", F.row_number().over(order))
    on = (F.col("_source") == F.col("_l_source")) & (F.col("_class") == F.col("_l_class")) & (F.col("_lot") == F.col("_l_lot"))
    rows = rows.join(lots.hint("merge"), on)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _draw(F.lit(f"start {seed}"), F.col("_source"))
    place = F.col("_before") + F.col("_rank")
    copies = F.least(F.floor(rate * place + start) - F.floor(rate * (place - 1) + start), F.lit(most)).cast("int")
    return rows.select(*kept, "size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``mix`` as often as the mix takes it."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
