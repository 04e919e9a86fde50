"""The registered queries, as they are, over tables with nulls in all columns, repeated ids and rows, empty and very long texts,
ties and extra columns, against plain versions; and over empty tables."""

import random
from collections import Counter

import pytest

from tests.llm import brute
from veilmark.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, h long, row string, node long, name string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def documents():
    r = random.Random(9)
    prose = lambda k: " ".join(f"w{r.randrange(400)}" for _ in range(k))
    texts = [prose(r.randrange(1, 80)) for _ in range(60)]
    passage = prose(50)
    texts += [None, "", "", " \n\t", "one", texts[0], texts[0], texts[1] + " extra", f"{prose(9)} {passage}\nline", f"{passage} {prose(7)}\nline"]
    texts += ["\n".join(["line", prose(12)]) for _ in range(12)] + [" ".join(f"v{i % 977}x{i}" for i in range(60_000))]
    docs = list(enumerate(texts))
    docs += [(3, texts[3]), (3, texts[3]), (3, texts[4]), (None, texts[5]), (None, texts[5]), (None, None), (None, "line")]
    return [(i, t, None if n % 7 == 0 else "en", [None, "a", "b", "ä", ""][n % 5], None if n % 3 else 1, "k", n, "r", n, None) for n, (i, t) in enumerate(docs)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = documents()
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, None, int(i % 4 == 0)) for i in range(60)] + [(0, 1, 0), (None, 1, 1), (5, 1, None), (7, 1, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(i, None if i % 5 == 0 else f"http://h/{i}", [None, "", "<p>a</p>", "é" * 9000, f"<p>{i}</p>"][i % 5]) for i in range(25)]
    pages += [(None, "http://n/", "<p>a</p>"), (None, None, None), (4, "http://again/", "<p>4</p>"), (4, "http://again/", "<p>4</p>")]
    spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string").write.parquet(f"{at}/pages.parquet")
    vectors = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], None), (None, [0.01, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [None, 1.0], 1), (2, [1.0, 0.01], 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, [d[:2] for d in docs], docs, pages


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("nothing"))
    for name, kinds in {"documents": COLUMNS, "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], kinds).write.parquet(f"{at}/{name}.parquet")
    return at


def test_lines(spark, tables):
    got = queries.op1_line_dedup(spark, tables[0])
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.lines(tables[1]), key=str)


def test_warc(spark, tables):
    got = queries.op2_warc(spark, tables[0])
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(brute.warc([(p, h) for p, _, h in tables[3]]), key=str)


def test_shards(spark, tables):
    got = queries.op3_sharding(spark, tables[0]).collect()
    docs = tables[1]
    want = Counter((d, len((t or "").encode()) + 1, brute.crc(t)) for d, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want and {r["law"] for r in got} == {"bytes"}
    by, group = Counter(), Counter()
    for r in got:
        by[r["shard"]] += r["size"]
        group[r["text_crc32"], r["size"]] += r["size"]
    # the law: each shard's bytes are the equal share, but for one group of copies at each of its ends
    share = sum(by.values()) / 16
    assert set(by) <= set(range(16)) and all(abs(by[s] - share) <= max(group.values()) for s in range(16))
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(len({r["shard"] for r in got if (r["text_crc32"], r["size"]) == g}) == 1 for g in group)


def test_exact(spark, tables):
    got = queries.op4_exact_dedup(spark, tables[0])
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(tables[1]), key=str)


def test_mix(spark, tables):
    got = queries.op5_mixing(spark, tables[0]).collect()
    size = Counter()
    for _, t, _, s, *_ in tables[2]:
        size[s] += len(brute.WORD.findall(t or ""))
    want, taken = brute.targets(size), Counter()
    assert len(got) == len(tables[1]) and all(r["taken"] <= 3 * r["size"] for r in got)
    kept = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert kept == {(size[s], round(want[s], 6)) for s in size}
    assert sorted(map(tuple, queries.op5_mixing(spark, tables[0]).collect()), key=str) == sorted(map(tuple, got), key=str)
    for r in got:
        taken[round(r["target"], 6)] += r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(v - t * sum(round(want[s], 6) == t for s in want)) <= 3 * largest for t, v in taken.items())


def test_toxicity(spark, tables):
    got = queries.op6_toxicity(spark, tables[0]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in tables[1])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is not None and brute.crc(str(r["doc_id"])) % 5 == 0) for r in got)


def test_bpe(spark, tables):
    import numpy as np
    import public_tokenizers
    import tiktoken

    from veilmark.llm import bpe

    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.BPE_FILE), special_tokens={})
    want = []
    for d, t in tables[1]:
        ids = ref.encode_ordinary(t or "")
        want.append((d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t or "")))
    assert rows(queries.op7_bpe(spark, tables[0]), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_similar(spark, tables):
    """Rows that repeat an id share a component; rows without one link with nothing."""
    docs = tables[1]
    named = list(enumerate(docs))
    sets = {n: brute.shingles(t) for n, (_, t) in named}
    links = [(a, b) for a, _ in named for b, _ in named if a < b and sets[a] and sets[b] and docs[a][0] is not None and docs[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    links += [(a, b) for a, (i, _) in named for b, (j, _) in named if a < b and i == j and i is not None]
    group = brute.components([n for n, _ in named], links)
    least = {}
    for n, (d, _) in named:
        if d is not None:
            least[group[n]] = min(d, least.get(group[n], d))
    want = [(d, len(sets[n]), None if d is None else least[group[n]]) for n, (d, _) in named]
    assert rows(queries.op8_ngram_join(spark, tables[0]), "doc_id", "n_shingles", "component_id") == sorted(want, key=str)


def test_vectors(spark, tables):
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert rows(queries.op9_embedding_dedup(spark, tables[0]), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=str)


def test_repeats(spark, tables):
    got = queries.op10_substring_dedup(spark, tables[0])
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeats(tables[1]), key=str)


def test_empty_tables(spark, nothing):
    for name, query in {**queries.queries(), "pipeline": corpus_pipeline.run}.items():
        assert query(spark, nothing).isEmpty(), name


def test_pipeline(spark, tables):
    """All stages in one run: what comes out was in, encoded as it is after the lines are gone, and of near copies there is one."""
    got = corpus_pipeline.run(spark, tables[0]).collect()
    lines = {(d, s) for d, _, _, s in brute.lines(tables[1])}
    assert got and {r["doc_id"] for r in got} <= {d for d, _ in tables[1]}
    assert sum((r["doc_id"], r["decoded_sha256"]) in lines for r in got) >= 0.9 * len(got)
    assert max(Counter((r["doc_id"], r["decoded_sha256"]) for r in got).values()) <= 3 * 3
    copies = {c: {d for d, _, x in brute.similar([x for x in dict(tables[1]).items() if x[0] is not None]) if x == c} for c in (0, 1)}
    assert all(len({r["doc_id"] for r in got} & members) <= 1 for members in copies.values())
