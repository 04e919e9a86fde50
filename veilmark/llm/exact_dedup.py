"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text's bytes are cut into blocks of a fixed size. The distinct blocks, sorted, get integer names; then pairs of names side
by side get names, again and again, until every document is down to one. Equal names mean equal content at every level, so
two documents of the same number of rounds have the same name exactly when their bytes are the same: no content is taken
for another's by a hash. The order is by part, then content; the part is a hash of the content into a number of parts that
follows from the number of rows alone, so names depend on the data and neither on the cluster nor on its settings. Contents that make up a thousandth of all rows or more are few; they are named apart, in the order of their
content, and looked up in a broadcast, so that no task gets all rows of one content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilmark.operators.skew import HOT_PARTS, join_counted
from veilmark.scratch import cut

BLOCK_BYTES = 4096
#: Rows of a part (32 MB of blocks), until there are so many parts; beyond that parts grow, and are sorted on disk.
PART_ROWS, PARTS = 8192, 1 << 16


def _named(rows: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with ``name`` (long) instead of ``key``: one integer for each distinct content.

    The hash here only finds contents that are frequent and the part that a row goes to; what is compared is the content."""
    route = F.xxhash64(key)
    counts = cut(rows.groupBy(route.alias("_fp")).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    parts = min(PARTS, max(8, -(-total // PART_ROWS)))
    #: fewer than HOT_PARTS rows, as each has over total / HOT_PARTS of the total
    frequent = counts.where((F.col("_n") * HOT_PARTS > total) & (F.col("_n") > 1)).select("_fp")
    marked = rows.withColumn("_fp", route).join(F.broadcast(frequent.withColumn("_is_hot", F.lit(True))), "_fp", "left")
    hot = marked.where("_is_hot").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot.select(F.col(key).alias("_hk"), (-F.row_number().over(Window.orderBy(key))).cast("long").alias("_hn"))
    placed = marked.join(F.broadcast(hot), F.col("_is_hot") & (F.col(key) == F.col("_hk")), "left")
    #: rows of frequent contents are named already and go through the join without a key, dealt by ``spread``
    side = F.when(F.col("_hn").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread))
    placed = placed.withColumns({"_side": side, "_key": F.when(F.col("_hn").isNull(), F.col(key))}).drop("_fp", "_is_hot", "_hk", key)
    #: 0, but not a literal: it stays a key, so that names are dealt for the join as the rows are
    names = marked.where("_is_hot is null").select(F.col(key).alias("_ck"), F.col("_fp").bitwiseAND(F.lit(0).cast("long")).alias("_c_side"))
    #: the number of partitions is given, so these are the parts under any settings
    names = names.repartition(parts, "_ck", "_c_side").dropDuplicates(["_ck", "_c_side"]).sortWithinPartitions("_ck").withColumn("_cn", F.monotonically_increasing_id())
    out = placed.repartition(parts, "_key", "_side").join(names.hint("merge"), (F.col("_key") == F.col("_ck")) & (F.col("_side") == F.col("_c_side")), "left")
    return out.select(*[c for c in rows.columns if c != key], F.coalesce("_hn", "_cn").alias("name"))


def content_names(docs: DataFrame, content: Column, row: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, times, rounds, name): of each row, the number of rounds and the integer that stand for its content.

    ``row`` tells rows of different content apart; rows alike in it and in content come out once, with how often they occur.
    Names are the same for the same content within one call only."""
    data = docs.select(row.alias("row"), F.encode(content, "UTF-8").alias("data"))
    size = F.length("data")
    blocks = data.select("row", F.ceil(F.greatest(size, F.lit(1)) / block_bytes).cast("int").alias("n"), "data").select(
        "row",
        "n",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)))).alias("at", "block"),
    )
    level = cut(_named(blocks, "block", "row").groupBy("row", "n", "at", "name").agg(F.count(F.lit(1)).alias("times")))
    done, rounds = level.where("n = 1").select("row", "times", F.lit(0).alias("rounds"), "name"), 0
    level = level.where("n > 1")
    while not level.isEmpty():
        rounds += 1
        pairs = level.groupBy("row", (F.col("at") / 2).cast("int").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("right"),
            F.ceil(F.max("n") / 2).cast("int").alias("n"),
            F.max("times").alias("times"),
        )
        pairs = pairs.select("row", "times", "n", "at", F.struct("left", "right").alias("pair"))
        level = cut(_named(cut(pairs), "pair", "row"))
        done = done.unionByName(level.where("n = 1").select("row", "times", F.lit(rounds).alias("rounds"), "name"))
        level = level.where("n > 1")
    return done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): of equal texts, the row with the largest (``keep="max"``) or smallest id stays.

    Null texts count as empty. Groups are decided by names alone; rows that repeat an id, or have none, are told apart by
    their text's SHA-256. Rows that repeat id and text are all members of their group and all stay or go together; rows
    without an id stay only if no row of the group has one. An empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    best = F.max if keep == "max" else F.min
    named = content_names(docs, text, row, block_bytes).select(F.col("row.id").alias("id"), F.lower(F.hex("row.digest")).alias("text_sha256"), "times", F.struct("rounds", "name").alias("identity"))
    groups = cut(named.groupBy("identity").agg(best("id").alias("keep_id"), F.sum("times").alias("group_size"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    joined = join_counted(named, groups, ["identity"], total, "n", "id")
    out = joined.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
    return out.select(F.explode(F.array_repeat(F.struct("id", "keep_id", "group_size", "kept", "text_sha256"), F.col("times").cast("int"))).alias("r")).select("r.*")
