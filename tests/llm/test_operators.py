"""Every operator against a plain version, over small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veilmark.llm.hashing import text_bytes, words
from veilmark.llm import bpe, embedding_dedup, exact_dedup, line_dedup, mixing, ngram_join, sharding, substring_dedup, toxicity, warc

WORDS = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "Theta", "iota", "kappa", "λ", "mu"]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def corpus(n=120, seed=3):
    """(doc_id, text): random prose with copies, near copies, shared lines and passages, empty, null and one long text."""
    r = random.Random(seed)
    prose = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(k))
    passage, line = prose(45), "  Shared LINE here\t"
    docs = []
    for i in range(n):
        kind = i % 10
        text = prose(r.randrange(1, 90))
        if kind == 1 and docs:
            text = r.choice(docs)[1]
        elif kind == 2 and docs and r.choice(docs)[1]:
            base = (r.choice([d for d in docs if d[1]])[1]).split(" ")
            base[r.randrange(len(base))] = "changed"
            text = " ".join(base)
        elif kind == 3:
            text = prose(10) + "\n" + line + "\n" + prose(12)
        elif kind == 4:
            text = prose(8) + " " + passage + "\n" + prose(5)
        elif kind == 5:
            text = ["", None, "one", " \n\t ", line.lower()][i // 10 % 5]
        docs.append((i, text))
    docs.append((n, "\n".join(prose(40) for _ in range(120))))
    docs.append((n + 1, passage + " " + passage))
    return docs


def frame(spark, docs, extra=False):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("h", "row", "doc", "size", "key", "n", "kept", "name")}) if extra else df


def test_lines(spark):
    docs = corpus()
    got = line_dedup.dedup_lines(frame(spark, docs, extra=True), min_docs=10).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert rows(got, "doc_id", "n_lines", "n_dropped", "sha") == sorted(brute.lines(docs), key=str)


def test_lines_of_a_key_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = [(i, "same\nother %d" % i) for i in range(400)]
        for keep, dropped in (("none", 400), ("first", 399)):
            got = line_dedup.dedup_lines(frame(spark, docs), min_docs=10, keep=keep)
            assert got.agg(F.sum("n_dropped")).first()[0] == dropped
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("keep", ["none", "first"])
def test_lines_of_many_rows_without_an_id(spark, monkeypatch, keep):
    """They count as one document; what they hold of a line is written down, not held."""
    monkeypatch.setattr(line_dedup, "HELD", 7)
    docs = [(None, f"often\n{i}\nrare") for i in range(2000)] + [(i, "often\nelse") for i in range(3)]
    got = line_dedup.dedup_lines(frame(spark, docs), min_docs=4, keep=keep)
    assert got.agg(F.sum("n_dropped")).first()[0] == (2003 if keep == "none" else got.agg(F.count_if(F.col("n_dropped") == 1)).first()[0])
    gone = got.where("n_dropped > 0").count()
    assert gone == 2003 if keep == "none" else gone in range(1, 2003)
    assert line_dedup.dedup_lines(frame(spark, docs), min_docs=5, keep=keep).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_bitmaps_round_trip():
    drop = np.array([0, 3, 17])
    keep = line_dedup.unpack(line_dedup.pack(drop), 30)
    assert len(keep) == 30 and np.flatnonzero(~keep).tolist() == drop.tolist()


def test_repeated_rows_and_missing_ids(spark):
    docs = [(1, "a\nb"), (1, "a\nb"), (1, "c"), (None, "a"), (None, None), (2, "a")]
    got = line_dedup.dedup_lines(frame(spark, docs), min_docs=3)
    assert rows(got, "doc_id", "text") == sorted([(1, "b"), (1, "b"), (1, "c"), (None, ""), (None, None), (2, "")], key=str)
    got = exact_dedup.exact_groups(frame(spark, docs))
    assert rows(got, "id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(docs), key=str)
    assert substring_dedup.remove_repeats(frame(spark, docs)).count() == len(docs)
    assert sharding.shards(frame(spark, docs), 4).count() == len(docs)
    assert mixing.mix(frame(spark, docs).withColumn("source", F.lit(None).cast("string"))).count() == len(docs)
    assert ngram_join.similar_groups(frame(spark, docs)).count() == len(docs)


def test_empty_tables(spark):
    docs = frame(spark, []).withColumn("source", F.lit("s"))
    assert line_dedup.dedup_lines(docs).isEmpty()
    assert sharding.shards(docs, 4).isEmpty()
    assert exact_dedup.exact_groups(docs).isEmpty()
    assert mixing.mix(docs).isEmpty()
    assert ngram_join.similar_groups(docs).isEmpty()
    assert substring_dedup.remove_repeats(docs).isEmpty()
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()
    assert toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).isEmpty()


def test_warc(spark):
    pages = [(i, f"http://h/{i}", ["<p>a</p>", "<p>é</p>" * 50, None, "", "<p>%d</p>" % i][i % 5]) for i in range(40)] + [(100, None, "x"), (101, "http://a b\n", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for least in (0, 20):
        read = warc.archive(df, min_bytes=least)
        page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).cast("long")
        got = read.select(page("record_id").alias("p"), "payload_length", F.coalesce("payload_digest", "header_digest").alias("d"), "record_type", page("refers_to").alias("r"))
        want = brute.warc([(p, h) for p, _, h in pages], least)
        assert rows(got, *got.columns) == sorted(want, key=str)
        assert read.where("record_type = 'revisit'").count() == sum(w[3] == "revisit" for w in want)
        assert read.where("payload is not null").select("payload_digest", "header_digest").where("payload_digest <> header_digest").isEmpty()


def test_warc_filters_are_pushed(spark):
    df = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x")], "page_id long, url string, html string")
    read = warc.archive(df).where("record_type = 'response' and target_uri = 'http://a/'")
    assert [r["record_id"] for r in read.collect()] == ["<urn:page:1>"]
    reader = warc._Reader({"path": "unused"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_length",), 3)]))
    assert len(left) == 1 and reader.wanted == [("warc-type", frozenset(["response"]))]


def test_warc_members_without_lengths(tmp_path):
    import gzip

    data = [warc.record("response", f"<urn:page:{i}>", "http://x/", "2024-01-01T00:00:00Z", b"y" * (5000 * i)) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    (tmp_path / "b.warc").write_bytes(b"".join(data))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(warc.member(d) for d in data))
    reader = warc._Reader({"path": str(tmp_path)})
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["record_id"], r["payload_length"], len(r["payload"])) for r in found] == [(f"<urn:page:{i}>", 5000 * i, 5000 * i) for i in range(4)] * 3
    spread = warc._Reader({"path": str(tmp_path), "minPartitions": "3", "payload": "digest"})
    parts = [[r for b in spread.read(p) for r in b.to_pylist()] for p in spread.partitions()]
    assert len(parts) >= 2 and [(r["record_id"], r["payload_digest"]) for p in parts for r in p] == [(r["record_id"], r["payload_digest"]) for r in found] and all(r["payload"] is None for p in parts for r in p)


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, law):
    docs = corpus()
    got = sharding.shards(frame(spark, docs, extra=True), 5, law).collect()
    texts = dict(docs)
    assert len(got) == len(docs)
    by = {s: [r for r in got if r["shard"] == s] for s in range(5)}
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == brute.crc(texts[r["doc_id"]]) for r in got)
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        assert all(len({r["shard"] for r in got if (texts[r["doc_id"]] or "") == t}) == 1 for t in {t or "" for t in texts.values()})


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_exact_groups(spark, block):
    docs = corpus()
    got = exact_dedup.exact_groups(frame(spark, docs, extra=True), block_bytes=block)
    assert rows(got, "id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(docs), key=str)


def test_names_do_not_depend_on_partitions(spark):
    df = frame(spark, corpus())
    names = lambda df: rows(exact_dedup.content_names(df, F.coalesce("text", F.lit("")), F.col("doc_id"), 64).where("name >= 0"), "row", "rounds", "name")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        other = names(df.repartition(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert other == names(df)


def test_mix(spark):
    docs = [(i, t, [None, "a", "b", "ä", "Z"][i % 5]) for i, t in corpus(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == len(brute.WORD.findall(r["text"] or "")) and r["copies"] <= 3
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    want = brute.targets(size)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in want)
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in want)
    assert rows(mixing.mix(df.repartition(7)), "doc_id", "copies") == sorted(((r["doc_id"], r["copies"]) for r in got), key=str)
    assert mixing.emit(mixing.mix(df), ["doc_id"]).count() == sum(r["copies"] for r in got)


def test_lots_part_rows_without_an_id(spark, monkeypatch):
    """No lot holds much more than its share, whatever ids are missing or repeated."""
    monkeypatch.setattr(mixing, "LOT_ROWS", 200)
    docs = [(None if i % 2 else 7, " ".join(f"w{i}" for _ in range(3)), "a") for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    draw = mixing._draw(F.lit("1"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))
    assert max(r["count"] for r in df.groupBy(F.floor(draw * 20)).count().collect()) < 300
    mixed = mixing.mix(df)
    assert mixed.count() == 4000 and abs(mixed.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] - 12_000) <= 3


def test_similar(spark):
    docs = corpus(200)
    got = ngram_join.similar_groups(frame(spark, docs, extra=True))
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.similar(docs), key=str)


def test_similar_with_many_tiles(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        docs.append((i, " ".join(w[: r.randrange(80, 121)])))
    monkeypatch.setattr(ngram_join, "BLOCK", 600)
    monkeypatch.setattr(ngram_join, "SIGNED_BLOCK", 900)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 9)
    got = ngram_join.similar_groups(frame(spark, docs))
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.similar(docs), key=str)


def test_similar_of_many_sizes(spark):
    """One text cut to all lengths: links chain over bands, and a short text lies in the group of long ones."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(base[: 6 + i * 3])) for i in range(120)] + [(500 + i, " ".join(base[100 : 300 - r.randrange(60)] + [f"y{i}"] * 30)) for i in range(40)]
    assert rows(ngram_join.similar_groups(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == sorted(brute.similar(docs), key=str)


def test_bound_holds():
    r = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(r.integers(0, 1 << 62, r.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(0, len(a) + 1)], r.integers(0, 1 << 62, r.integers(1, 300)).astype(np.uint64)]))
        k = len(np.intersect1d(a, b))
        assert ngram_join.common(a, b) == k <= ngram_join.bound(ngram_join.signature(a), len(a), ngram_join.signature(b), len(b))


def vector_frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "node": F.lit(2), "leaf": F.lit(3)})


def planted(n, width, seed, low=0.95, high=0.99):
    """``n`` vectors and, for every fourth, another at a cosine between ``low`` and ``high``."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, n - 1, 4):
        side = r.standard_normal(width)
        side -= (side @ x[i]) * x[i]
        c = r.uniform(low, high)
        x[i + 1] = 3 * (c * x[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


VECTORS = [(900, None), (901, [0.0] * 16), (902, [None] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [1.0] * 3), (906, [])]


def test_vectors_of_one_leaf(spark):
    data = planted(300, 16, 2) + VECTORS
    data += [(1000 + i, data[8][1]) for i in range(40)] + [(2000, [-0.0] + [1.0] * 15), (2001, [0.0] + [1.0] * 15)]
    got = embedding_dedup.near_vectors(vector_frame(spark, data), leaf=1000, block=64, trees=3)
    want = brute.vectors([(i, v if v and len(v) == 16 else None) for i, v in data])
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == sorted(want, key=str)


def test_repeated_and_missing_vector_ids(spark):
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [0.01, 1.0]), (None, [-1.0, 0.0]), (3, [1.0, 0.0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (None, 1, 1, False), (None, 0, None, True), (3, 2, 1, False)]
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == sorted(want, key=str)


@pytest.mark.parametrize("leaf, sample, depth", [(48, 20_000, 6), (24, 64, 7)])
def test_recall_of_deep_trees(spark, leaf, sample, depth):
    """The forest as in production but for the size of leaves; with 64 sampled vectors, levels below the second are Spark's."""
    data = planted(2400, 64, 5)
    df = vector_frame(spark, data)
    got = embedding_dedup.near_vectors(df, leaf=leaf, sample=sample)
    want = {w[0]: w for w in brute.vectors(data)}
    found = {r["vec_id"]: (r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()}
    links = sum(w[1] for w in want.values())
    assert links >= 1200 and sum(f[1] for f in found.values()) >= 0.95 * links
    assert all(f[1] <= want[i][1] for i, f in found.items())  # none is counted twice
    assert sum(found[i] == w for i, w in want.items()) >= 0.95 * len(want)


def test_overfull_leaves_are_split(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((600, 8)), np.full((100, 8), 1.0) + r.standard_normal((100, 8)) * 1e-6])
    x /= np.linalg.norm(x, axis=1)[:, None]
    placed = spark.createDataFrame([(i, 1, v.tobytes(), [1]) for i, v in enumerate(x)], "node long, n long, vector binary, leaves array<long>")
    done = embedding_dedup.split_overfull(placed, 20, 0.01, 3).select("node", F.explode("leaves").alias("leaf"))
    sizes = {k["leaf"]: k["count"] for k in done.groupBy("leaf").count().collect()}
    assert done.select("node").distinct().count() == 700
    assert sorted(v for v in sizes.values() if v > 80)[-1] >= 100  # the tight cluster stays whole
    assert sum(v > 80 for v in sizes.values()) <= 4 and len(sizes) > 8


def test_repeats(spark):
    docs = corpus(150)
    for window, phrase in ((35, 8), (6, 3)):
        got = substring_dedup.remove_repeats(frame(spark, docs, extra=True), window=window, phrase=phrase).withColumn("sha", F.sha2("kept", 256))
        assert rows(got, "doc_id", "n_words", "n_removed", "sha") == sorted(brute.repeats(docs, window), key=str)


def test_occurrences_are_of_whole_words_within_a_document():
    texts = ["a b c d", "xa b c d", "a b\u00e9 c", "c d a b", "b c", "  a  b c\n", "a b cc b c", "xb c", "ab c b"]
    raw, ends = substring_dedup.text_bytes(pa.array(texts))
    w = substring_dedup.words(raw, ends)
    flat = [x for t in texts for x in brute.WORD.findall(t)]
    want = [i for d, t in enumerate(texts) for i in range(w.of_doc[d], w.of_doc[d + 1] - 2 + 1) if flat[i : i + 2] == ["b", "c"]]
    assert substring_dedup.occurrences(raw, w, np.array([1]), 2).tolist() == want


def test_windows_come_from_the_automata_alone(monkeypatch):
    """What the automata find, and nothing else, makes windows candidates: the places that windows picked are fewer."""
    r = random.Random(2)
    prose = lambda k: [f"w{r.randrange(3000)}" for _ in range(k)]
    passage = prose(10)
    docs = [" ".join(prose(20) + passage + prose(20)) for _ in range(40)] + [" ".join(prose(60)) for _ in range(5)]
    table = pa.table({"doc_id": list(range(len(docs))), "text": docs, "_row": list(range(len(docs))), "_shard": pa.array([0] * len(docs), pa.int32())})
    raw, ends = text_bytes(table.column("text"))
    w = words(raw, ends)
    start, at, grams = substring_dedup.picks(w, 12, 4)
    picked, times = np.unique(grams[np.unique(at)], return_counts=True)
    confirmed = picked[times > 1]
    phrases = pa.table({"shard": pa.array([0] * len(confirmed), pa.int32()), "h": confirmed.view(np.int64)})
    candidates = lambda: sum(abs(n) for n in substring_dedup._windows("text", 12, 4, 8)(table, phrases).column("n").to_pylist() if n > 0)
    through = candidates()
    hit = np.flatnonzero(np.isin(grams, confirmed) & (np.searchsorted(w.of_doc, np.arange(len(grams)), side="right") == np.searchsorted(w.of_doc, np.arange(len(grams)) + 3, side="right")))
    assert through == sum(((hit >= s) & (hit <= s + 8)).any() for s in start.tolist()) > 0
    own = np.unique(at[np.isin(grams[at], confirmed)])
    monkeypatch.setattr(substring_dedup, "occurrences", lambda *a: own)  # a look-up of picked places by hash
    assert candidates() < through
    monkeypatch.setattr(substring_dedup, "occurrences", lambda *a: np.zeros(0, np.int64))
    assert candidates() == 0


def test_repeats_among_many_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", 2000)
    r = random.Random(6)
    text = " ".join(f"w{r.randrange(400)}" for _ in range(50))
    docs = [(None, text if i % 2 else None) for i in range(3000)] + [(i, " ".join(f"v{r.randrange(400)}" for _ in range(45)) + (" " + text if i % 5 == 0 else "")) for i in range(20)]
    got = substring_dedup.remove_repeats(frame(spark, docs)).withColumn("sha", F.sha2("kept", 256))
    assert rows(got, "doc_id", "n_words", "n_removed", "sha") == sorted(brute.repeats(docs), key=str)


def test_regular_words_are_told_apart(spark):
    """Complementary Thue-Morse words, which sums of letters by powers of a base take for one another."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"x{i}" for i in range(40))
    docs = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} y"), (4, f"{b} y"), (5, f"{a} {a} {b} {rest[:9]}"), (6, f"{a} {b} {b} {rest[:9]}")]
    assert rows(ngram_join.similar_groups(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == sorted(brute.similar(docs), key=str)
    got = substring_dedup.remove_repeats(frame(spark, docs), window=2, phrase=1).withColumn("sha", F.sha2("kept", 256))
    assert rows(got, "doc_id", "n_words", "n_removed", "sha") == sorted(brute.repeats(docs, 2), key=str)


def test_bpe(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    r = random.Random(4)
    letters = ["a", "th", "ing", " ", "  ", "\n", "é", "'s", "1", "٣", "́", "\x1c", " ", "🙂", "漢", ".", "tion"]
    docs = corpus(60) + [(1000 + i, "".join(r.choice(letters) for _ in range(r.randrange(60)))) for i in range(300)]
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = bpe.decode(bpe.encode(frame(spark, docs), path, public_tokenizers.PATTERN), path, chunk=3)
    for x in got.collect():
        assert np.frombuffer(x["ids"], "<u4").tolist() == ref.encode_ordinary(x["text"] or "")
        assert bytes(x["decoded"]) == (x["text"] or "").encode()
    want = sorted((d, len(ref.encode_ordinary(t or "")), brute.sha(np.array(ref.encode_ordinary(t or ""), "<u4").tobytes()), brute.sha(t or "")) for d, t in docs)
    assert rows(bpe.round_trip(frame(spark, docs, extra=True), path, public_tokenizers.PATTERN, chunk=3), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    clash = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, None, None)], "doc_id long, text string, ids int, decoded string")
    again = bpe.decode(bpe.encode(clash, path, public_tokenizers.PATTERN), path).collect()
    assert [bytes(r["decoded"]) for r in again] == [b"a b", b"a b", b""] and bpe.round_trip(clash, path, public_tokenizers.PATTERN).columns == ["doc_id", "decoded", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.decode(bpe.encode(clash.limit(0), path, public_tokenizers.PATTERN), path).isEmpty() and bpe.round_trip(clash.limit(0), path, public_tokenizers.PATTERN).isEmpty()


def white_space_ranks(ranks, pairs=()):
    """The vocabulary with tokens for runs of white space, whose left parts are tokens too."""
    more = dict(ranks)
    for token in (b"  ", b"\n ", b" \n", b"   ", b"\n\n", b"\n\n ", *pairs):
        if token not in more:
            more[token] = max(more.values()) + 1
    return more


def test_bpe_cuts_texts_where_matches_end():
    """With tokens for white space a cut inside a match would show."""
    import public_tokenizers
    import tiktoken

    ranks = white_space_ranks(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    ids = lambda t: np.frombuffer(encoder(t), "<u4").tolist()
    for t in ("a  ", "x\n ", "  ", " ", "   ", " a", "  a", "a \n", "a  b", "a\n b", "\n\n b ", "a\u3000 ", "\x1c ", "a \x1c"):
        assert ids(t) == ref.encode_ordinary(t), repr(t)
    r = random.Random(12)
    letters = ["a", "the", " ", " ", " ", "\n", "\t", "é", "'s", "1", "\x1c", "\u3000", "."]
    for _ in range(20_000):
        t = "".join(r.choice(letters) for _ in range(r.randrange(9)))
        assert ids(t) == ref.encode_ordinary(t), repr(t)


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"[^ ]+ ?| +", r"\p{L}+ \p{L}+|\s|\S"])
def test_bpe_under_other_patterns(pattern):
    """Their matches may hold spaces anywhere."""
    import public_tokenizers
    import tiktoken

    ranks = white_space_ranks(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), (b"a ", b"e "))
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder, r = bpe.Encoder(ranks, pattern), random.Random(13)
    for _ in range(3000):
        t = "".join(r.choice(["a", "the", " ", " ", "\n", "é", "1"]) for _ in range(r.randrange(9)))
        assert np.frombuffer(encoder(t), "<u4").tolist() == ref.encode_ordinary(t), repr(t)


def test_transducer_emits_before_the_end():
    import public_tokenizers

    t = bpe.Transducer(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    word = b"internationalisation" * 20
    s, seen = 0, 0
    for byte in word:
        s, certain = t.advance(s, byte)
        seen += len(certain)
    whole = t.encode(word)
    assert len(whole) - 8 <= seen < len(whole) and all(len(path) <= 8 for path, _ in t.walks[s])
    assert whole == t.follow(t.start, word)


def test_decoder_keeps_unfinished_characters():
    d = bpe.StreamDecoder({0: b"a\xc3", 1: b"\xa9b", 2: b"\xff", 3: b"\xf0\x9f"})
    assert d.feed([0]) == b"a" and d.feed([1]) == b"\xc3\xa9b" and d.feed([2]) == b"\xff"
    assert d.feed([3]) == b"" and d.flush() == b"\xf0\x9f"
    pieces = [b"\xe2", b"\x82", b"\xac", b"a", b"\x80", b"\xe0\x80", b"\xf4\x90", b"\xc2", b"\xf0\x9f\x99\x82", b"\xed\xa0", b"\xf3\xa0\x80"]
    r = random.Random(3)
    for _ in range(300):
        ids = [r.randrange(len(pieces)) for _ in range(r.randrange(1, 12))]
        d, seen, pending = bpe.StreamDecoder(dict(enumerate(pieces))), b"", b""
        for i in range(0, len(ids), 2):
            whole, pending = bpe.complete(pending, b"".join(pieces[k] for k in ids[i : i + 2]))
            assert d.feed(ids[i : i + 2]) == whole and d.pending == pending
            seen += whole
        assert seen + d.flush() == b"".join(pieces[k] for k in ids)


def plain_logits(texts, model):
    """Word by word and window by window, as the network is defined."""
    p, H, out = model["params"], toxicity.HIDDEN, []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for t in texts:
        found = [x.encode() for x in brute.WORD.findall(t.translate(brute.UPPER))]
        inputs = []
        for word in found:
            h = toxicity.words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hash[0]
            at = np.flatnonzero(model["vocabulary"] == h)
            ends = [0, *word, 0]
            slots = [((a * 257 + b) * 0x9E3779B1 % (1 << 32)) >> 20 for a, b in zip(ends, ends[1:])]
            inputs.append(np.concatenate([p["word"][at[0] + 1 if len(at) else 0], p["char"][slots].mean(axis=0)]))
        n = len(found)
        starts = [0] if n <= toxicity.WINDOW else [*range(0, n - toxicity.WINDOW, toxicity.STRIDE), n - toxicity.WINDOW]
        best = -np.inf
        for lo in starts:
            x = inputs[lo : lo + toxicity.WINDOW]
            states = {}
            for d in "fb":
                h, seen = np.zeros(H), []
                for v in x if d == "f" else x[::-1]:
                    g = v @ p[f"x{d}"] + p[f"b{d}"]
                    z, r = np.split(sigmoid(g[: 2 * H] + h @ p[f"z{d}"]), 2)
                    h = h + z * (np.tanh(g[2 * H :] + (r * h) @ p[f"c{d}"]) - h)
                    seen.append(h)
                states[d] = np.array(seen if d == "f" else seen[::-1]).reshape(-1, H)
            both = np.concatenate([states["f"], states["b"]], axis=1)
            w = np.exp(both @ p["att"] - (both @ p["att"]).max(initial=-1e9))
            pooled = (w / w.sum()) @ both if len(both) else np.zeros(2 * H)
            best = max(best, pooled @ p["out"] + p["bias"][0])
        out.append(best)
    return np.array(out)


def test_toxicity_network_is_as_defined():
    texts = [t or "" for _, t in corpus(40)] + ["", "one", " ".join(f"w{i % 9}" for i in range(33)), " ".join(f"w{i % 7}" for i in range(81))]
    found = np.unique(toxicity.words(*toxicity.text_bytes(pa.array(texts)), lower=True).hash)[::2]
    model = {"vocabulary": found, "params": toxicity.init(len(found)), "scale": 1.0, "shift": 0.0}
    r = np.random.default_rng(3)
    model["params"] = {k: v + r.standard_normal(v.shape).astype(np.float32) * np.float32(0.2) for k, v in model["params"].items()}
    model["params"]["word"][0] = 0
    got = toxicity.score_texts(pa.array(texts), model)
    want = 1 / (1 + np.exp(-plain_logits(texts, model)))
    assert np.abs(got - want).max() < 2e-4


def test_toxicity_gradients():
    texts = ["a bad word here", "quite plain text", "w " * 20, "bad"]
    column = pa.array(texts)
    found = np.unique(toxicity.words(*toxicity.text_bytes(column), lower=True).hash)
    batch = toxicity.Batch(column, found)
    r = np.random.default_rng(5)
    p = {k: v.astype(np.float64) + r.standard_normal(v.shape) * 0.2 for k, v in toxicity.init(len(found)).items()}
    p["word"][0] = 0
    y, weight, some = np.array([1.0, 0.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5, 1.0]), np.arange(4)

    def loss(p):
        _, logit = toxicity._gradients(batch, some, y, weight, p)
        return float((weight * (np.log1p(np.exp(-np.abs(logit))) + np.maximum(logit, 0) - y * logit)).sum() / weight.sum())

    g, _ = toxicity._gradients(batch, some, y, weight, p)
    for k in p:
        flat = np.flatnonzero(np.abs(g[k]) > 1e-5)
        for i in r.choice(flat, min(6, len(flat)), replace=False).tolist():
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k].flat[i] += 1e-3
            down[k].flat[i] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3 - g[k].flat[i]) < 2e-3 * max(1, abs(g[k].flat[i])) + 1e-4, (k, i)


def test_toxicity_learns_and_scores_all_windows(spark):
    r = random.Random(6)
    prose = lambda k: [r.choice(WORDS) + str(r.randrange(40)) for _ in range(k)]
    docs, labels = [], []
    for i in range(400):
        w = prose(r.randrange(5, 150))
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["vile", "nasty", "horrid"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += [(1000, ""), (1001, None), (1002, " ".join(prose(400) + ["vile", "horrid"]))]
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(df, model).withColumn("held", toxicity.held_out()).collect()}
    truth = dict(labels)
    held = [d for d in truth if brute.crc(str(d)) % 5 == 0]
    right = sum((got[d] >= 0.5) == bool(truth[d]) for d in held)
    assert right >= 0.9 * len(held) and all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001] < 0.5
    alone = toxicity.score_texts(pa.array([docs[7][1]]), model)[0]
    assert abs(alone - got[7]) < 1e-4


def test_candidates_of_groups_of_all_sizes():
    """Groups below the limit give all their pairs, near copies once a run of common numbers; larger ones give chains."""
    sim = ngram_join.Similarity(75)
    rng = np.random.default_rng(5)
    common = np.sort(rng.integers(1, 1 << 62, 400, dtype=np.uint64))
    sets = [np.sort(np.concatenate([np.delete(common, [k]), rng.integers(1, 1 << 62, 3, dtype=np.uint64)])) for k in range(12)]
    columns = [[], [], [], [], []]
    for doc, s in enumerate(sets):
        h = s[: sim.prefix(len(s))]
        for c, x in zip(columns, (h, np.full(len(h), doc, np.int64), np.full(len(h), len(s), np.int32), np.arange(len(h), dtype=np.int32), np.concatenate([np.zeros(1, np.uint64), h])[: len(h)])):
            c.append(x)
    columns = [np.concatenate(c) for c in columns]
    deal = (columns[0] % np.uint64(16)).astype(np.int64)  # as many buckets as ranges of the hash would be
    rows = [(u, int((deal == u).sum()), b"".join(c[deal == u].tobytes() for c in columns)) for u in np.unique(deal).tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["bucket", "n", "blob"])
    every = {(i, j) for i in range(12) for j in range(i + 1, 12)}
    for limit, kind in ((12, 0), (4, 1)):
        found = [tuple(r.values()) for b in ngram_join._candidates(sim, limit)(iter([batch])) for r in b.to_pylist()]
        assert {k for k, *_ in found} == {kind}
        if kind == 0:
            assert {(a, b) for _, a, b in found} == every
            assert len(found) < 6 * len(every)  # as many as buckets, 16, before
        else:
            assert {a for _, a, _ in found} | {b for _, _, b in found} == set(range(12))
