"""Splitting and ordering groups of documents by the tags that they have.

Groups are folded to signatures, the sets of their tags; plans are made over the table of signatures and carried out by the
places that groups have within their signature. Tags are a vocabulary, so are few, and so are the signatures met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators.corpus import _sized, global_rank, rank_within, seeded_digest
from veilmark.scratch import cut

#: Signatures that a plan is made for on the driver.
MOST_SIGNATURES = 100_000
FIRST = ("train", "test", "validation", "calibration")


def tagged_groups(df: DataFrame, group: str, tags: str, seed: str) -> DataFrame:
    """(group, signature, docs, _digest): the sorted tags of all documents of each group; documents without tags give __negative__,
    others __positive__ besides."""
    flag = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, "__positive__").otherwise("__negative__")
    long = df.select(group, F.explode(F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(flag))).alias("tag"))
    docs = df.groupBy(group).agg(F.count(F.lit(1)).alias("docs"))
    #: tags are folded before they are gathered: as many as the vocabulary has
    sets = long.distinct().groupBy(group).agg(F.array_sort(F.collect_list("tag")).alias("signature"))
    return cut(docs.join(sets.hint("merge"), group).withColumn("_digest", seeded_digest(seed, group)))


def _signatures(groups: DataFrame) -> list[tuple[tuple[str, ...], int, int]]:
    table = groups.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("docs"))
    rows = table.limit(MOST_SIGNATURES + 1).collect()
    if len(rows) > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} sets of tags")
    return sorted((tuple(r["signature"]), r["n"], r["docs"]) for r in rows)


def tag_targets(counts: dict[str, int], ratios: dict[str, float]) -> dict[str, dict[str, int]]:
    """How many groups of each tag each split should have: largest remainders, then one for each split, in the order of
    ``FIRST``, from whichever has most and more than one."""
    order = [s for s in FIRST if s in ratios] + [s for s in ratios if s not in FIRST]
    out = {}
    for tag, n in counts.items():
        share = {s: n * r for s, r in ratios.items()}
        quota = {s: int(x) for s, x in share.items()}
        by_rest = sorted(ratios, key=lambda s: (quota[s] - share[s], order.index(s)))
        for s in by_rest[: n - sum(quota.values())]:
            quota[s] += 1
        for s in order[:n]:
            largest = max(quota, key=lambda x: quota[x])
            if not quota[s] and quota[largest] > 1:
                quota[largest] -= 1
                quota[s] = 1
        out[tag] = quota
    return out


def level(wants: dict[str, int], n: int, order: list[str]) -> dict[str, int]:
    """``n`` things to whoever wants most at the time, one by one; ties by ``order``. Whole levels are taken at once."""
    given = dict.fromkeys(wants, 0)
    left = dict(wants)
    while n:
        top = max(left.values())
        who = sorted((s for s in left if left[s] == top), key=order.index)
        below = max((v for v in left.values() if v < top), default=None)
        rounds = n // len(who) if below is None else min(top - below, n // len(who))
        for s in who:
            given[s], left[s] = given[s] + rounds, left[s] - rounds
        n -= rounds * len(who)
        if n < len(who) and (below is None or top - rounds > below):
            for s in who[:n]:
                given[s] += 1
            n = 0
    return given


def plan_splits(signatures: list[tuple[tuple[str, ...], int, int]], ratios: dict[str, float]) -> list[tuple[tuple[str, ...], int, int, str]]:
    """(signature, from, to, split): the tag that fewest groups left have is dealt first, then the next.

    Of a signature, splits get what brings them level in how much of the tag at hand they miss, then in room for documents."""
    counts: dict[str, int] = {}
    for tags, n, _ in signatures:
        for t in tags:
            counts[t] = counts.get(t, 0) + n
    targets = tag_targets(counts, ratios)
    order = [s for s in FIRST if s in ratios] + [s for s in ratios if s not in FIRST]
    total = sum(d for *_, d in signatures)
    room = {s: total * r for s, r in ratios.items()}
    have = {t: dict.fromkeys(ratios, 0) for t in counts}
    left, plan = {tags: (n, docs) for tags, n, docs in signatures}, []
    while left:
        now: dict[str, int] = {}
        for tags, (n, _) in left.items():
            for t in tags:
                now[t] = now.get(t, 0) + n
        rare = min(now, key=lambda t: (now[t], t))
        for tags in sorted(s for s in left if rare in s):
            n, docs = left.pop(tags)
            by_room = sorted(ratios, key=lambda s: (-room[s], order.index(s)))
            at = 0
            for s, k in level({s: targets[rare][s] - have[rare][s] for s in ratios}, n, by_room).items():
                if k:
                    plan.append((tags, at, at + k, s))
                    at += k
                    room[s] -= docs * k / n
                    for t in tags:
                        have[t][s] += k
    return plan


def rarest_first_split(df: DataFrame, group: str, tags: str, ratios: dict[str, float], seed: str) -> DataFrame:
    """``df`` with split: groups stay whole, and every tag is spread as near to ``ratios`` as whole groups allow, rare ones first."""
    if any(r <= 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-8:
        raise ValueError("ratios must be positive and sum to one")
    groups = tagged_groups(df, group, tags, seed)
    plan = plan_splits(_signatures(groups), ratios)
    ranges = df.sparkSession.createDataFrame([(list(t), a, b, s) for t, a, b, s in plan], "_sig array<string>, _lo long, _hi long, split string")
    placed = rank_within(groups, ["signature"], ["_digest", group])
    on = (F.col("signature") == F.col("_sig")) & (F.col("place") > F.col("_lo")) & (F.col("place") <= F.col("_hi"))
    #: at most MOST_SIGNATURES times the splits; broadcast if few
    done = placed.join(_sized(ranges), on).select(F.col(group).alias("_g"), "split")
    return df.drop("split").join(done.hint("merge"), F.col(group) == F.col("_g")).drop("_g")


def plan_order(signatures: list[tuple[tuple[str, ...], str]], support: dict[str, int], rare: int) -> list[tuple[tuple[str, ...], bool, int | None]]:
    """(signature, rare, number) from signatures with the digest of their first group: whether all their groups come first, and
    which number its first group has among those that cover the tags left, in the order of the tags' support."""
    few = {t for t, n in support.items() if n <= rare}
    is_rare = {tags: bool(few.intersection(tags)) for tags, _ in signatures}
    covered = {t for tags, r in is_rare.items() if r for t in tags}
    first = {}
    for tags, by in sorted(signatures, key=lambda s: s[1]):
        for t in tags:
            first.setdefault(t, tags)
    numbers: dict[tuple[str, ...], int] = {}
    for t in sorted(support, key=lambda t: (support[t], t)):
        if t not in covered:
            numbers[first[t]] = len(numbers)
            covered.update(first[t])
    return [(tags, is_rare[tags], numbers.get(tags)) for tags, _ in signatures]


def nested_order(df: DataFrame, group: str, tags: str, seed: str, rare: int = 10) -> DataFrame:
    """(group, docs, rank, anchor): an order whose every prefix is a sample of all groups by signature.

    Groups with a tag that at most ``rare`` documents have come first, all of them; then, for each tag that no group has yet,
    the first group that has it; these are anchors. The others follow by how far along their signature they are. The first
    group with a tag is the first of its signature, so the plan needs one row a signature, refused above ``MOST_SIGNATURES``;
    groups find their turn in it by their place within the signature."""
    groups = tagged_groups(df, group, tags, seed)
    folded = groups.groupBy("signature").agg(F.min(F.struct("_digest", group)).alias("by"), F.count(F.lit(1)).alias("n")).limit(MOST_SIGNATURES + 1).collect()
    support = df.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SIGNATURES + 1).collect()
    if max(len(folded), len(support)) > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} tags or sets of tags")
    plan = plan_order([(tuple(r["signature"]), tuple(r["by"])) for r in folded], {r["tag"]: r["n"] for r in support}, rare)
    size = {tuple(r["signature"]): r["n"] for r in folded}
    table = _sized(df.sparkSession.createDataFrame([(list(t), size[t], r, n) for t, r, n in plan], "_sig array<string>, _n long, _rare boolean, _number int"))
    placed = rank_within(groups, ["signature"], ["_digest", group]).join(table, F.col("signature") == F.col("_sig"))
    covers = F.col("_number").isNotNull() & (F.col("place") == 1)
    turn = F.when(F.col("_rare"), 0).when(covers, 1).otherwise(2)
    lead = F.when(F.col("_number").isNotNull(), 1).otherwise(0)
    along = F.when(turn == 1, F.col("_number").cast("double")).when(turn == 2, (F.col("place") - lead - 0.5) / (F.col("_n") - lead)).otherwise(0.0)
    ranked = global_rank(placed.select(group, "docs", "_digest", turn.alias("_turn"), along.alias("_along")), ["_turn", "_along", "_digest", group])
    return ranked.select(group, "docs", "rank", (F.col("_turn") < 2).alias("anchor"))
