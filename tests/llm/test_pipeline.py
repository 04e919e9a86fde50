"""The pipeline's stages, each on what the one before kept, against plain versions."""

from pathlib import Path

import pytest

from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    words = "alpha beta gamma delta eta theta iota kappa mu nu".split()
    docs, labels = [], []
    for i in range(240):
        text = " ".join(words[(i * 7 + k * k) % 10] + str((i * 31 + k * 17) % 97) for k in range(12 + i % 30))
        if i % 6 == 0:
            text += " vile horrid"
        if i % 10 == 3:
            text += "\nshared line"
        if i % 12 == 5:
            text = docs[i - 1][1] + " extra"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, rows = at.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, at = [(r["doc_id"], r["text"]) for r in at.collect()], spark.read.parquet(str(tmp_path / name))
        rows[name] = (before, at)
        assert name == "bpe" or at.columns == columns
    kept = {r["doc_id"] for r in rows["toxicity"][1].collect()}
    assert {900, 901} <= kept and sum(d in kept for d in range(0, 240, 6)) < 12 and sum(d in kept for d in range(240) if d % 6) > 180
    before, after = rows["line_dedup"]
    assert sorted(((r["doc_id"], brute.sha(r["text"] or "")) for r in after.collect()), key=str) == sorted(((d, s) for d, _, _, s in brute.lines(before)), key=str)
    before, after = rows["ngram_join"]
    assert {r["doc_id"] for r in after.collect()} == {d for d, _, c in brute.similar(before) if d == c}
    before, after = rows["mixing"]
    assert {r["doc_id"] for r in after.collect()} <= {d for d, _ in before} and not after.isEmpty()
    before, after = rows["bpe"]
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in after.collect()) == sorted((d, brute.sha(t or "")) for d, t in before)


def test_registered():
    assert Path(corpus_pipeline.__file__).parent == Path(__file__).parents[2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_in_many_rounds(spark, monkeypatch):
    """The third stage's plan keeps short estimates where its edges take several rounds."""
    from veilmark.operators import components

    monkeypatch.setattr(components, "TASK_EDGES", 4)
    text = lambda k: " ".join(f"w{k + i}" for i in range(80))  # noqa: E731  each is similar to the next ones
    docs = spark.createDataFrame([(7 * k % 61, text(k)) for k in range(60)], "doc_id long, text string").repartition(6)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 5000
    assert [r.doc_id for r in kept.collect()] == [0]
