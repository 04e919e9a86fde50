"""Groups of records that share a key, and what must not be split between data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilmark.operators.components import connected_components
from veilmark.operators.skew import first_of_key, look_up
from veilmark.scratch import cut


def key_components(df: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """(id, component, group_id): records linked by any equal key; null and empty keys link nothing.

    Each key's records are tied to the least of them, so a key's edges are as many as its records. ``group_id`` is a digest
    of how many ids the component has and of four sums of parts of their SHA-256: the same for the same ids in any order,
    and no task holds a component's ids."""
    numbered = cut(df.select(F.col(id_col).alias("id"), *[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"k{i}").alias("key")) for i in range(len(keys))]))
    long = numbered.select("id", pairs.alias("p")).select("id", "p.kind", "p.key").where("key is not null and key <> ''")
    heads = long.groupBy("kind", "key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
    edges = look_up(long, heads, ["kind", "key"], "n", "id").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    found = connected_components(edges)
    out = cut(numbered.select("id").join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    digest = F.sha2(F.col("id").cast("string"), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    gid = out.groupBy("component").agg(F.count(F.lit(1)).alias("n"), *parts)
    gid = gid.select("component", "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[f"s{i}" for i in range(4)]), 256).alias("group_id"))
    return look_up(out, gid, ["component"], "n", "id").select(F.col("id").alias(id_col), "component", "group_id")


def quarantine(df: DataFrame, component: str, split: str) -> DataFrame:
    """Components with rows in two official splits or more: (component, splits, reason)."""
    g = df.groupBy(component).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
    return g.select(component, F.array_join("splits", ",").alias("splits"), F.lit("component_spans_splits").alias("reason"))


def discard_equal_texts(df: DataFrame, text_key: Column, id_col: str) -> DataFrame:
    """(id, retained_id): rows whose text another row with a lesser id has. Null texts are no texts."""
    rows = df.select(text_key.alias("_key"), F.col(id_col)).where("_key is not null")
    least = rows.groupBy("_key").agg(F.min(id_col).alias("retained_id"), F.count(F.lit(1)).alias("_n"))
    return look_up(rows, least, ["_key"], "_n", id_col).where(F.col("retained_id") != F.col(id_col)).select(id_col, "retained_id")


def contradictory(df: DataFrame, text_key: Column, spans: Column) -> DataFrame:
    """Text keys that come with more than one annotation."""
    return df.groupBy(text_key.alias("text_key")).agg(F.countDistinct(spans).alias("n")).where("n > 1")


def representatives(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return first_of_key(df, key, [F.col(c) for c in order], "_first").where("_first").drop("_first")


def least_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order) of the least row of each key by ``order``, where no other columns are asked for: rows alike in these are one.

    One shuffle, of a row a key and map task; null keys are a key."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_least")).select(*keys, "_least.*")


def key_overlap(df: DataFrame, key: Column, split: str) -> DataFrame:
    """(split_a, split_b, n): keys found in both splits, from one grouping of the keys."""
    sets = df.groupBy(key.alias("k")).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    return sets.select("k", F.explode("s").alias("split_a"), "s").select("k", "split_a", F.explode("s").alias("split_b")).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n"))


def isolation_errors(df: DataFrame, keys: dict[str, Column], split: str) -> DataFrame:
    """(kind, key, n_splits) of keys found in more than one split."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), k.cast("string").alias("key")) for n, k in keys.items()]))
    long = df.select(F.col(split).alias("split"), pairs.alias("p")).select("split", "p.kind", "p.key").where("key is not null")
    return long.groupBy("kind", "key").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def leakage(df: DataFrame, keys: dict[str, Column], split: str, examples: int = 5) -> DataFrame:
    """(kind, split_a, split_b, n, examples) of keys found in both of two splits, the least keys as examples.

    A key's splits, a few names, are gathered in a partial aggregate; of a pair's keys each map task sends on its ``examples``
    least, so neither a hot key nor a leaking pair of splits is held anywhere. Null keys are none; pairs without any don't come."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), k.cast("string").alias("key")) for n, k in keys.items()]))
    long = df.select(F.col(split).alias("split"), pairs.alias("p")).select("split", "p.kind", "p.key").where("key is not null and split is not null")
    sets = long.groupBy("kind", "key").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    both = sets.select("kind", "key", "s", F.explode("s").alias("split_a")).select("kind", "key", "split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    by = ["kind", "split_a", "split_b"]
    least = both.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("_r") <= examples)
    #: a row for each kind and pair of splits
    shown = least.groupBy(*by).agg(F.array_sort(F.collect_list("key")).alias("examples"))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(shown), by)


def reconcile(raw: DataFrame, cleaned: DataFrame, removed: int, flagged: DataFrame, splits: DataFrame, domain: str, duplicate: str = "is_duplicate", split: str = "split") -> DataFrame:
    """(check, expected, actual, ok): what each stage must have left of the one before.

    Raw rows are the cleaned ones and those ``removed``; cleaned rows are the unique ones and the duplicates; all splits together
    are the unique rows; of each split the rows of its domains are its rows, with a null domain in none. Each table is counted once."""
    n = F.count(F.lit(1))
    totals = raw.agg(n.alias("raw")).crossJoin(cleaned.agg(n.alias("cleaned"))).crossJoin(flagged.agg(F.count_if(~F.col(duplicate)).alias("unique"), F.count_if(duplicate).alias("duplicates")))  # a row each
    by = splits.groupBy(split).agg(n.alias("rows"), F.count(domain).alias("of_domains"))
    totals = totals.crossJoin(by.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("split")))
    row = lambda name, expected, actual: F.struct(F.lit(name).alias("check"), expected.alias("expected"), actual.alias("actual"))
    checks = F.array(
        row("raw_equals_cleaned_plus_removed", F.col("raw") - F.lit(removed), F.col("cleaned")),
        row("cleaned_equals_unique_plus_duplicates", F.col("cleaned"), F.col("unique") + F.col("duplicates")),
        row("splits_equal_unique", F.col("unique"), F.col("split")))
    each = by.select(F.concat(F.col(split), F.lit("_domains_equal_total")).alias("check"), F.col("rows").alias("expected"), F.col("of_domains").alias("actual"))
    return totals.select(F.explode(checks).alias("c")).select("c.*").unionByName(each).withColumn("ok", F.col("expected") == F.col("actual"))


def alignment_audit(labels: DataFrame, splits: DataFrame, widths: dict[str, int], values: str = "probabilities") -> DataFrame:
    """(dimension, rows, least_width, greatest_width, width_ok, train, validation, test, unknown, missing): labels against splits.

    ``labels`` (record_id, dimension, values) should have vectors as wide as ``widths`` says and a row for each train record;
    ``missing`` is how many of these have none, ``unknown`` how many rows are of no split. One join by record, one row a dimension."""
    s = splits.select(F.col("record_id").alias("_id"), "split").distinct()
    j = labels.join(s.hint("merge"), F.col("record_id") == F.col("_id"), "left")
    size = F.size(values)
    of = lambda name: F.count_if(F.col("split") == name).alias(name)
    g = j.groupBy("dimension").agg(F.count(F.lit(1)).alias("rows"), F.min(size).alias("least_width"), F.max(size).alias("greatest_width"), of("train"), of("validation"), of("test"), F.count_if(F.col("split").isNull()).alias("unknown"), F.countDistinct(F.when(F.col("split") == "train", F.col("record_id"))).alias("_met"))
    expected = F.coalesce(*[F.when(F.col("dimension") == d, F.lit(w)) for d, w in widths.items()], F.lit(-1))
    #: one row
    train = s.where("split = 'train'").agg(F.countDistinct("_id").alias("_train"))
    out = g.crossJoin(F.broadcast(train)).withColumn("width_ok", (F.col("least_width") == expected) & (F.col("greatest_width") == expected))
    return out.select("dimension", "rows", "least_width", "greatest_width", "width_ok", "train", "validation", "test", "unknown", (F.col("_train") - F.col("_met")).alias("missing"))


def source_audit(df: DataFrame, source: str, split: str, budget: int) -> DataFrame:
    """(source, rows, budget, over_budget, splits, fingerprint) of each source; the fingerprint is that of its rows in any order."""
    digest = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u2205")) for c in sorted(df.columns)]))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    g = df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.sum(h.cast("decimal(28,0)")).alias("_s"), F.bit_xor(h).alias("_x"))
    return g.select(source, "rows", F.lit(budget).cast("long").alias("budget"), (F.col("rows") > budget).alias("over_budget"), "splits", F.concat_ws(":", F.col("rows").cast("string"), F.col("_s").cast("string"), F.col("_x").cast("string")).alias("fingerprint"))


def augment(train: DataFrame, generated: DataFrame, text_key: str, id_col: str, most: int, ratio: float) -> DataFrame:
    """``train`` and, of ``generated``, what fits under both caps and has no text of train."""
    limit = min(most, int(train.count() * ratio))
    fresh = generated.join(train.select(text_key).distinct(), text_key, "left_anti").orderBy(id_col).limit(limit)
    return train.unionByName(fresh)


def misplaced(df: DataFrame, generated: Column, split: str, allowed: list[str]) -> DataFrame:
    """Generated rows outside of the splits that may hold them; a null split is none of these."""
    return df.where(generated & ~F.coalesce(F.col(split).isin(*allowed), F.lit(False)))
