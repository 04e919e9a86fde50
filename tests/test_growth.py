"""Queries on larger and odd tables: results that stand still, and steps whose work grows no faster than their input."""

from __future__ import annotations

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from veilmark.operators import components
from veilmark.plans import registry
from veilmark.scratch import cut


def _answers(spark, tmp_path, name, **tables):
    """A query's rows and those of its SQL over tables of rows of (column, kind, values)."""
    con = duckdb.connect()
    for table, columns in tables.items():
        spark.createDataFrame(list(zip(*[v for _, _, v in columns])), ", ".join(f"{c} {k}" for c, k, _ in columns)).write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()[name])
    columns = [c for c, *_ in want.description]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted(map(tuple, got.select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)


def _lines(rows):
    """lineitem of (order, line number, part, supplier, flag, quantity, discount)."""
    kinds = [("l_orderkey", "long"), ("l_linenumber", "int"), ("l_partkey", "long"), ("l_suppkey", "long"), ("l_returnflag", "string"), ("l_quantity", "double"), ("l_discount", "double")]
    return [(c, k, list(v)) for (c, k), v in zip(kinds, zip(*rows))]


def test_decisions_at_exactly_the_threshold(spark, tmp_path):
    """Weighted scores of exactly 0.8, which sums of doubles put above it in some orders and not in others."""
    mixes = [m for m in itertools.product(range(5, 11), repeat=6) if sum(m) == 45]
    rows = [(i, j + 1, 1, 1, "A", 1.0, d / 100) for i, m in enumerate(mixes) for j, d in enumerate(m)]
    got, want = _answers(spark, tmp_path, "k16_decisions_by_method", lineitem=_lines(rows))
    above = sum(max(m) > 7 for m in mixes)
    assert got == want == [("max", above), ("weighted", 0)]


def _some_lines(n=400):
    """Orders with repeated line numbers, some rows of which are alike, and one order with a large share of all."""
    return [(i % 60 if i % 3 else 7, i % 5, i * 7 % 31, i * 5 % 17, "ANR"[i % 3], float(i % 50), i % 11 / 100) for i in range(n) for _ in range(1 + i % 2)]


@pytest.mark.parametrize("name", ["d06_span_match", "i04_strict_by_source", "i06_supported_types", "b17_bio_spans", "b24_prediction_spans", "d07_clean_attacked_pairs", "i04_strict_all_levels", "i05_class_scores", "i05_documents", "b25_coverage", "b25_window_contents"])
def test_queries_of_lines(spark, tmp_path, name):
    got, want = _answers(spark, tmp_path, name, lineitem=_lines(_some_lines()))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == (pytest.approx(b, rel=1e-9) if isinstance(b, float) else b) for a, b in zip(g, w))


def test_lines_are_read_and_shuffled_once(spark, tmp_path):
    """Lines were counted, written down, numbered and joined with their least orders."""
    from veilmark.plans.spans import lines

    spark.createDataFrame(_some_lines(), "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan and "ExistingRDD" not in plan


def test_spans_with_nulls_match_nothing(spark):
    from veilmark.operators.spans import match_spans

    kinds = "record long, s int, e int, type string"
    rows = [(1, 0, 5, "A"), (1, 0, 5, "A"), (2, 0, 5, None), (None, 0, 5, "A"), (3, 1, 2, "B")]
    m = match_spans(spark.createDataFrame(rows, kinds), spark.createDataFrame([*rows[:4], (4, 1, 2, "B")], kinds), ["record", "s", "e", "type"])
    assert sorted(m.select("tp", "fp", "fn").collect()) == [(0, 0, 1)] * 3 + [(0, 1, 0)] * 3 + [(1, 0, 0)]
    assert m._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_scores_by_method_shuffle_records_once(spark, tmp_path):
    """Rows were multiplied by scenarios before the shuffle, and shuffled once more by record and method."""
    from veilmark.operators import risk

    got, want = _answers(spark, tmp_path, "k09_method_scores", lineitem=_lines(_some_lines()))
    assert got == want
    e = spark.createDataFrame([(1, 3, 0.9, 2.0, "x"), (1, 1, 0.4, 1.0, "y")], "record long, tier int, confidence double, w double, grp string")
    rows = risk.method_scores(e, "record", ("x", "y"), risk.SCENARIOS)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(rows).count("Exchange") == 1 and plan(risk.sensitivity(rows, "record", scenarios=list(risk.SCENARIOS))).count("Exchange") == 2
    assert sorted(map(tuple, risk.sensitivity(rows, "record").collect())) == sorted(map(tuple, risk.sensitivity(rows, "record", scenarios=list(risk.SCENARIOS)).collect()))


def test_pinned_files_of_odd_languages(spark, tmp_path):
    """Languages were one file and one task each, in folders of their own names."""
    langs = ["", "en", "EN", "a/b", "ü", None]
    n = 60
    columns = [("doc_id", "long", list(range(n))), ("text", "string", [f"text {i}" for i in range(n)]), ("lang", "string", [langs[i % 6] for i in range(n)])]
    got, want = _answers(spark, tmp_path, "a10_pinned_files", documents=columns)
    assert got == want


def test_python_sees_a_slice_of_a_batch(spark):
    """A batch of ten thousand texts became Python objects at once."""
    from pyspark.sql import functions as F

    from veilmark.operators import evidence, spans

    df = spark.range(500, numPartitions=1).select(F.concat(F.lit("a@b.example "), F.col("id").cast("string")).alias("t"))
    sizes = evidence.annotate(df, lambda s: s.map(lambda _: len(s)), "int", "n", text_col="t", batch=50)
    assert sizes.agg(F.max("n")).first()[0] == 50
    assert df.select(F.size(evidence.offset_matches("t"))).groupBy().sum().first()[0] == 500
    rows = [(["ab", "##c", "d"], "abc d"), (["ab", "x"], "ab c"), (["ab"], "ab c"), (None, None), (None, "a"), ([], ""), (["ab"], None)] * 30
    o = spark.createDataFrame(rows, "w array<string>, t string").select(spans.token_offsets("w", "t").alias("o")).select("o.*").limit(7).collect()
    assert [tuple(r) for r in o] == [([0, 2, 4], [2, 3, 5], None), (None, None, "token 'x' does not follow"), ([0], [2], "text left over"), ([], [], None), ([], [], "text left over"), ([], [], None), (None, None, "token 'ab' does not follow")]


def test_template_queries_are_dealt(spark, tmp_path, monkeypatch):
    """All keys were one scan's task, and so was all work on them."""
    from veilmark.plans import fixtures

    monkeypatch.setattr(fixtures, "KEYS", 10)
    spark.range(200).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = fixtures.tq(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 20 and rows.count() == 200
    assert "Exchange" not in rows.groupBy("record_id").count()._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "").replace("Exchange hashpartitioning(c_custkey", "")


def test_windows_are_made_once(spark, tmp_path):
    """A filter that Spark inferred before exploding made all windows a second time."""
    spark.createDataFrame(_some_lines(), "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = registry.queries()["b25_window_contents"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "aggregate(" in line for line in plan.split("\n"))


def test_estimates_stay_short_over_rounds(spark, monkeypatch):
    """Components whose edges take several rounds: the estimated sizes of their plans were products over all rounds."""
    monkeypatch.setattr(components, "TASK_EDGES", 20)
    mixed = F.pmod(F.col("id") * 7919, F.lit(1009)).alias("a"), F.pmod((F.col("id") + 1) * 7919, F.lit(1009)).alias("b")
    edges = spark.range(1008).where("id % 112 <> 111").select(*mixed).repartition(8)
    found = components.connected_components(edges)
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100
    want = {}
    for lo in range(0, 1008, 112):
        nodes = [i * 7919 % 1009 for i in range(lo, lo + 112)]
        want |= dict.fromkeys(nodes, min(nodes))
    assert dict(found.collect()) == want


def test_cut_keeps_rows_order_and_dealing(spark):
    """A checkpoint whose estimate is dropped is still known to be dealt and sorted as it is."""
    rows = spark.range(64).select("id", (F.col("id") % 5).alias("k"))
    for _ in range(8):
        rows = rows.join(spark.range(64).hint("merge"), "id")
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = cut(rows.repartition(4, "k").sortWithinPartitions("k", "id"))
        assert size(rows) >= 1 << 64 > size(done)
        assert sorted(map(tuple, done.collect())) == [(i, i % 5) for i in range(64)]
        counted = done.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        assert done.alias("x").join(done.alias("y"), F.col("x.id") == F.col("y.id")).count() == 64
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
