"""Reading sources into one schema, cleaning, dedup, samples and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilmark.functions.text import cleaned, filled, hash_unit, stable_id
from veilmark.operators.skew import first_of_key, look_up
from veilmark.scratch import cut


def adapt(df: DataFrame, query: Column, answer: Column, source: str, domain: str) -> DataFrame:
    """One source's fields as (query_text, context_text, source_dataset, domain); falsy becomes the empty text."""
    return df.select(filled(query).alias("query_text"), filled(answer).alias("context_text"), F.lit(source).alias("source_dataset"), F.lit(domain).alias("domain"))


def or_else(*cols: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def harmonise(parts: list[DataFrame]) -> DataFrame:
    """All sources under one schema, with an id that follows from the content."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("record_id", stable_id("source_dataset", "query_text", "context_text"))


def explode_documents(df: DataFrame, table: str = "table", paragraphs: str = "paragraphs", questions: str = "questions") -> DataFrame:
    """A row for each question of a nested document, its context as JSON and the context's digest as group."""
    context = F.to_json(F.struct(F.col(table), F.col(paragraphs)))
    rows = df.withColumn("context_text", context).withColumn("q", F.explode(questions))
    group = F.coalesce(F.col(f"{table}.uid"), F.sha2("context_text", 256))
    return rows.select(F.col("q.uid").alias("source_record_id"), F.col("q.question").alias("query_text"), "context_text", group.alias("group_id"), F.sha2("context_text", 256).alias("context_group"))


def clean_records(df: DataFrame, nfkc: bool = True, short: int = 3) -> DataFrame:
    """Cleaned query and context, both together as normalized_text, and whether the query is short."""
    df = df.withColumns({"query_text": cleaned("query_text", nfkc), "context_text": cleaned("context_text", nfkc)})
    return df.withColumns({"normalized_text": F.trim(F.concat_ws(" ", "query_text", "context_text")), "is_short_text": F.length("query_text") < short})


def drop_short(df: DataFrame, min_len: int = 3) -> DataFrame:
    return df.where(F.length("query_text") >= min_len)


def dedup_flag(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """``df`` with is_duplicate: not the first of its key by ``order``; of rows alike in both, all but one."""
    return first_of_key(df, F.sha2(key, 256), order, "_first").withColumn("is_duplicate", ~F.col("_first")).drop("_first")


def dedup_stats(flagged: DataFrame) -> DataFrame:
    removed = F.count_if("is_duplicate")
    n = F.count(F.lit(1))
    return flagged.agg(n.alias("input"), (n - removed).alias("unique_rows"), removed.alias("removed"), F.when(n > 0, removed / n).otherwise(0.0).alias("ratio"))


def cap_per_group(df: DataFrame, group: str | list[str], order: list[Column], n: int, place: str | None = None) -> DataFrame:
    """The first n rows of each group, with their place if a column for it is named; partitions send on n rows of each at most."""
    by = [group] if isinstance(group, str) else group
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n)
    return rows.withColumnRenamed("_r", place) if place else rows.drop("_r")


def hash_sample(df: DataFrame, n: int, seed: str, id_col: str, by: str | None = None) -> DataFrame:
    """n rows (of each value of ``by``) with the least digests of seed, group and id: uniform whatever the order of the input."""
    rank = F.sha2(F.concat_ws("|", F.lit(seed), *([F.col(by).cast("string")] if by else []), F.col(id_col).cast("string")), 256)
    if by is None:
        return df.orderBy(rank, id_col).limit(n)
    return cap_per_group(df.withColumn("_d", rank), by, [F.col("_d"), F.col(id_col)], n).drop("_d")


def seeded_digest(seed: str, id_col: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256)


def group_bounds(df: DataFrame, by: list[str], order: list[str], places: dict[str, Column]) -> DataFrame:
    """(by, name, …): of each group the ``order`` of the row at each place, a column of the group's size ``n``; null for place 0.

    Keys alone are ranked, over range partitions of (group, order); no window and no task holds a group."""
    ranked = global_rank(df.select(*by, *order), [*by, *order])
    sizes = ranked.groupBy(*by).agg((F.min("rank") - 1).alias("_before"), F.count(F.lit(1)).alias("n"))
    #: as many rows as groups times places
    wanted = sizes.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("place"), (F.col("_before") + F.least(p, F.col("n"))).alias("rank"), (p > 0).alias("some")) for k, p in places.items()])).alias("w"))
    at = wanted.select(F.col("w.rank").alias("_rank"), "w.place", *[F.col(c).alias(f"_b_{c}") for c in by]).where("w.some")
    found = ranked.join(_sized(at), F.col("rank") == F.col("_rank")).select(*by, "place", F.struct(*order).alias("bound"))
    return found.groupBy(*by).pivot("place", list(places)).agg(F.first("bound"))


#: Rows of a table that may be broadcast, after they were counted.
FEW = 10_000


def _sized(table: DataFrame) -> DataFrame:
    """``table`` for a join: broadcast if it was counted and is small, else by shuffle."""
    table = cut(table)
    return F.broadcast(table) if table.count() <= FEW else table.hint("merge")


def rank_within(df: DataFrame, by: list[str], order: list[str], out: str = "place") -> DataFrame:
    """``df`` with the place (from 1) of each row in its group, by range partitions of (group, order)."""
    ranked = global_rank(df, [*by, *order]).withColumn("_group", F.struct(*by))
    first = ranked.groupBy("_group").agg((F.min("rank") - 1).alias("_before"), F.count(F.lit(1)).alias("_n"))
    placed = look_up(ranked, first, ["_group"], "_n", order[0])
    return placed.withColumn(out, F.col("rank") - F.col("_before")).drop("rank", "_group", "_before")


def _bounded(df: DataFrame, by: list[str], bounds: DataFrame) -> DataFrame:
    """``df`` with the bounds of its group, nulls being a group."""
    names = [c for c in bounds.columns if c not in by]
    keyed = bounds.select(F.struct(*by).alias("_g"), *names)
    return df.withColumn("_group", F.struct(*by)).join(_sized(keyed), F.col("_group") == F.col("_g"), "left").drop("_g", "_group")


def balanced(df: DataFrame, group: str, seed: str, id_col: str) -> DataFrame:
    """Every group cut to the size of the smallest, by digest; rows that repeat an id stay or go together."""
    #: one number, of one row a group
    least = df.groupBy(group).count().agg(F.min("count")).first()[0]
    if least is None:
        return df
    keyed = df.withColumn("_digest", seeded_digest(seed, id_col))
    bounds = group_bounds(keyed, [group], ["_digest", id_col], {"_last": F.lit(least)})
    return _bounded(keyed, [group], bounds).where(F.struct("_digest", id_col) <= F.col("_last")).select(*df.columns)


def stratified_split(df: DataFrame, by: str | None, id_col: str, seed: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """split: the first floor(n * train) rows of a stratum by digest, then floor(n * validation), the rest is test.

    Without ``by`` all rows are one stratum. Rows that repeat an id get the same split."""
    keyed = df.withColumns({"_digest": seeded_digest(seed, id_col), "_stratum": F.col(by) if by else F.lit("")})
    n = F.col("n")
    bounds = group_bounds(keyed, ["_stratum"], ["_digest", id_col], {"_t": F.floor(n * train), "_v": F.floor(n * train) + F.floor(n * validation)})
    at = F.struct("_digest", id_col)
    upto = lambda c: F.coalesce(at <= F.col(c), F.lit(False))
    split = F.when(upto("_t"), "train").when(upto("_v"), "validation").otherwise("test")
    return _bounded(keyed, ["_stratum"], bounds).withColumn("split", split).select(*[c for c in df.columns if c != "split"], "split")


def group_split(df: DataFrame, group: str, official: str | None, seed: str, ratios: dict[str, float]) -> DataFrame:
    """split by a threshold on the group's hash, so that groups stay whole; official splits are kept and train is carved."""
    u = hash_unit(F.lit(seed), F.col(group))
    out, bound = None, 0.0
    for name, share in ratios.items():
        bound += share
        out = F.when(u < bound, name) if out is None else out.when(u < bound, name)
    out = out.otherwise(list(ratios)[-1])
    if official:
        out = F.when(F.col(official).isin("validation", "test"), F.col(official)).otherwise(F.when(out == "calibration", "calibration").otherwise(F.coalesce(F.col(official), out)))
    return df.withColumn("split", out)


def merge_first(parts: list[DataFrame], id_col: str) -> DataFrame:
    """Union of parts, of each id the row of the earliest part."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    return cap_per_group(rows, id_col, [F.col("_part")], 1).drop("_part")


def nested_subsets(df: DataFrame, id_col: str, seed: str, fractions: list[float], anchor: Column | None = None) -> DataFrame:
    """(id, fraction): each fraction holds all smaller ones and every anchor row; ranks are over anchors, then digests."""
    first = F.when(anchor, 0).otherwise(1) if anchor is not None else F.lit(1)
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256)
    ranked = global_rank(df.withColumns({"_first": first, "_digest": digest}), ["_first", "_digest"])
    n = F.broadcast(ranked.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_first") == 0).alias("_anchors")))
    rows = ranked.join(n).withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    return rows.where(F.col("rank") <= F.greatest("_anchors", F.ceil(F.col("_n") * F.col("fraction")))).select(id_col, "fraction", "rank")


def _ordered_parts(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` in range partitions of a total order, with _pid and _at (rising within a partition); and each partition's offset."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_base"))
    #: one row a partition
    return parts, counts.select("_pid", "_base", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_offset"))


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with rank from 1 in a total order, by range partitions and the offsets of their counts."""
    parts, offsets = _ordered_parts(df, order)
    return parts.join(F.broadcast(offsets), "_pid").withColumn("rank", F.col("_at") - F.col("_base") + F.col("_offset") + 1).drop("_pid", "_at", "_base", "_offset")


def budget_prefix(ranked: DataFrame, rank: str, cost: str, budget: float, anchor: Column | None = None) -> DataFrame:
    """The largest prefix by rank whose cost is within the budget, with ``spent`` up to each row.

    Rows of ``anchor`` come first and are mandatory: an error if they do not fit. No two ranks are equal."""
    first = F.when(anchor, 0).otherwise(1) if anchor is not None else F.lit(1)
    rows = ranked.select(F.struct("*").alias("_row"), first.alias("_first"), F.col(rank).alias("_by"), F.col(cost).alias("_cost"))
    sums = running_sum(rows, ["_first", "_by"], "_cost", "spent")
    if anchor is not None and (need := sums.where("_first = 0").agg(F.max("spent")).first()[0]) is not None and need > budget:
        raise ValueError(f"anchors cost {need}, over the budget of {budget}")
    return sums.where(F.col("spent") <= budget).select("_row.*", "spent")


def running_sum(df: DataFrame, order: list[str], value: str, out: str = "running", rank: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row of a total order, and its rank if one is named.

    Sums run within cells of 4,096 rows; before these come the sums of a range partition's earlier cells, and before these
    the totals of the partitions, which are one row each."""
    parts, offsets = _ordered_parts(df, order)
    rows = parts.join(F.broadcast(offsets), "_pid").withColumn("_cell", F.floor((F.col("_at") - F.col("_base")) / 4096))
    cells = rows.groupBy("_pid", "_cell").agg(F.sum(value).alias("_s"))
    totals = cells.groupBy("_pid").agg(F.sum("_s").alias("_t"))
    totals = totals.select("_pid", F.sum("_t").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_parts"))
    inner = Window.partitionBy("_pid").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("_cells", F.sum("_s").over(inner)).join(F.broadcast(totals), "_pid")
    #: null until a value is met
    both = F.coalesce(F.col("_cells") + F.col("_parts"), "_cells", "_parts")
    before = before.select("_pid", "_cell", both.alias("_before"))
    run = F.sum(value).over(Window.partitionBy("_pid", "_cell").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    done = rows.withColumn("_run", run).join(before.hint("merge"), ["_pid", "_cell"]).withColumn(out, F.coalesce(F.col("_before") + F.col("_run"), "_before", "_run"))
    if rank:
        done = done.withColumn(rank, F.col("_at") - F.col("_base") + F.col("_offset") + 1)
    return done.drop("_pid", "_at", "_base", "_offset", "_cell", "_run", "_before")


def whole_group_sample(df: DataFrame, group: str, limit: int, seed: str) -> DataFrame:
    """Rows of whole groups, in the order of their digests, up to ``limit`` rows; a group that does not fit is passed over.

    Each round takes the prefix that fits and drops the groups that are larger than what is left; the sizes of the groups
    that overflow fall, so rounds are no more than distinct sizes."""
    if limit < 1:
        raise ValueError("limit must be positive")
    left = cut(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.sha2(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")), 256)))
    taken, room = None, limit
    while True:
        left = cut(left.where(F.col("n") <= room))
        if room <= 0 or left.isEmpty():
            break
        sums = cut(running_sum(left, ["digest", group], "n"))
        fits = sums.where(F.col("running") <= room)
        stop = sums.where(F.col("running") > room).agg(F.min("running")).first()[0]
        room -= fits.agg(F.coalesce(F.max("running"), F.lit(0))).first()[0]
        taken = fits.select(group) if taken is None else taken.unionByName(fits.select(group))
        left = sums.where(F.col("running") >= stop).drop("running") if stop is not None else sums.limit(0).drop("running")
    if taken is None:
        raise ValueError("no group fits the limit")
    return df.join(taken.hint("merge"), group, "left_semi")


def exact_targets(df: DataFrame, by: str, group: str, targets: dict[str, int], seed: str) -> DataFrame:
    """Whole-group samples of exactly the target size for each value of ``by``; a deficit is an error."""
    parts = []
    for value, n in targets.items():
        part = whole_group_sample(df.where(F.col(by) == value), group, n, seed)
        if (got := part.count()) != n:
            raise ValueError(f"{value}: {got} of {n} rows")
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def quota_split(df: DataFrame, source: str, group: str, ratios: dict[str, int], seed: str) -> DataFrame:
    """split with exact quotas of each source, groups intact and within one source; quotas that cannot be met are an error.

    Groups are counted by size; the table of sizes, a few rows a source, is dealt out by the largest share still missing,
    large groups first, and groups take their place within their size by digest."""
    sizes = df.groupBy(source, group).agg(F.count(F.lit(1)).alias("size"))
    sizes = cut(sizes.withColumn("_digest", seeded_digest(seed, group)))
    placed = rank_within(sizes, [source, "size"], ["_digest", group])
    table = sorted((r[source], r["size"], r["count"]) for r in sizes.groupBy(source, "size").count().collect())
    whole = sum(ratios.values())
    plan = []
    for s in sorted({t[0] for t in table}):
        rows = sum(n * k for x, n, k in table if x == s)
        if any(rows * r % whole for r in ratios.values()):
            raise ValueError(f"{s}: {rows} rows do not divide by {ratios}")
        need = {name: rows * r // whole for name, r in ratios.items()}
        for size, count in sorted(((n, k) for x, n, k in table if x == s), reverse=True):
            at = 0
            while at < count:
                name = max(need, key=lambda k: (need[k], k))
                take = min(count - at, max(1, (need[name] - sorted(need.values())[-2]) // size if len(need) > 1 else count))
                take = min(take, need[name] // size)
                if take < 1:
                    raise ValueError(f"{s}: quotas cannot be met with whole groups")
                plan.append((s, size, at, at + take, name))
                need[name] -= take * size
                at += take
    ranges = df.sparkSession.createDataFrame(plan, f"_s {df.schema[source].dataType.simpleString()}, _size long, _lo long, _hi long, split string")
    #: a few ranges for each source and size
    on = (F.col(source) == F.col("_s")) & (F.col("size") == F.col("_size")) & (F.col("place") > F.col("_lo")) & (F.col("place") <= F.col("_hi"))
    return df.join(placed.join(F.broadcast(ranges), on).select(group, "split").hint("merge"), group)


def reference_set(df: DataFrame, domain: str, strata: list[str], id_col: str, quota: int, seed: str, share: float = 2 / 3, tags: dict[str, Column] | None = None) -> DataFrame:
    """(…, part, priority): a sample of each domain for people to look at, spread over its strata, for calibration and evaluation.

    Each stratum gives up to its even part of the domain's ``quota``, one at least, the first by digest; of these ``share`` are
    for calibration, one at least. What calibration and then evaluation still miss of the quota comes from the domain's other
    rows by digest. ``priority`` lists the names of ``tags`` that hold. Ids are distinct."""
    keyed = df.withColumn("_digest", seeded_digest(seed, id_col))
    counts = cut(keyed.groupBy(domain, *strata).agg(F.count(F.lit(1)).alias("_n")))
    #: one row a domain
    even = counts.groupBy(domain).agg(F.greatest(F.lit(1), F.floor(F.lit(quota) / F.count(F.lit(1)))).cast("int").alias("_even"))
    by = [domain, *strata]
    first = cap_per_group(keyed, by, [F.col("_digest"), F.col(id_col)], quota, "_place")
    first = first.join(_sized(even.withColumnRenamed(domain, "_d")), F.col(domain).eqNullSafe(F.col("_d"))).where(F.col("_place") <= F.col("_even")).drop("_d")
    #: at most the quota's worth of rows of each stratum from here on
    sizes = Window.partitionBy(*by)
    part = F.when(F.col("_place") <= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(sizes) * share + 1e-9)), "calibration").otherwise("evaluation")
    first = cut(first.withColumn("part", part).drop("_place", "_even"))
    got = first.groupBy(domain).agg(F.count_if(F.col("part") == "calibration").alias("_c"), F.count_if(F.col("part") == "evaluation").alias("_e"))
    rest = keyed.join(first.select(F.col(id_col).alias("_taken")).hint("merge"), F.col(id_col) == F.col("_taken"), "left_anti")
    rest = cap_per_group(rest, [domain], [F.col("_digest"), F.col(id_col)], quota, "_place")
    rest = rest.join(_sized(got.withColumnRenamed(domain, "_d")), F.col(domain).eqNullSafe(F.col("_d"))).drop("_d")
    miss_c = F.greatest(F.lit(0), F.floor(F.lit(quota * share + 1e-9)) - F.col("_c"))
    miss_e = F.greatest(F.lit(0), quota - (F.col("_c") + miss_c) - F.col("_e"))
    more = F.when(F.col("_place") <= miss_c, "calibration").when(F.col("_place") <= miss_c + miss_e, "evaluation")
    rows = first.unionByName(rest.withColumn("part", more).where("part is not null").drop("_place", "_c", "_e")).drop("_digest")
    return rows.withColumn("priority", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (tags or {}).items()]).cast("array<string>")))
