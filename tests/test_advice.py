"""Whole jobs, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from veilmark.operators import corpus, spans

MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
TEXTS = ["x@y.io, xx@y.io; x@y.io ax@y.io.", "é\U0001f600 to a1.b@c-d.org and A@B.CO\nand a1.b@c-d.org", "zz@zz.zz", "no address @ all", None]


def plain(value, attack):
    """The attacks that change an address."""
    return {
        "character_substitution": lambda v: v.translate(str.maketrans("aeo", "аео")),
        "separator_insertion": "​".join,
        "symbol_replacement": lambda v: v.translate(str.maketrans("@.-", "＠．－")),
        "email_obfuscation": lambda v: v.replace("@", " [at] ").replace(".", " [dot] "),
        "digit_words": lambda v: "".join(f" {spans.DIGITS[int(c)]} " if c in "0123456789" else c for c in v).strip(),
        "case": str.swapcase,
        "token_splitting": " ".join,
    }.get(attack, lambda v: v)(value)


def brute(texts):
    """By (id, attack): the new text and (start, end, changed) of each address."""
    out = {}
    for i, t in enumerate(texts):
        for attack in spans.ATTACKS:
            new, at, marks = "", 0, []
            for m in re.finditer(MAIL, t or ""):
                w = plain(m.group(), attack)
                new += t[at : m.start()] + w
                marks.append((len(new) - len(w), len(new), w != m.group()))
                at = m.end()
            if any(c for *_, c in marks):
                out[i, attack] = (new + t[at:], marks)
    return out


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def query(name):
    import __spark_entry__ as e

    return e.queries()[name]


def test_every_address_is_attacked(spark, folder):
    want = brute(TEXTS)
    rows = query("b27_attack_records")(spark, folder).collect()
    got = {(r["parent_id"], r["attack"]): (r["text"], [(s["start"], s["end"], c) for s, c in zip(r["spans"], r["entity_changed"])]) for r in rows}
    assert got == want and len(rows) == len(want)
    mails = sorted((i, plain(v, "email_obfuscation"), len(plain(v, "email_obfuscation")) - len(v)) for i, t in enumerate(TEXTS) for v in re.findall(MAIL, t or ""))
    assert sorted(map(tuple, query("b27_email_attack")(spark, folder).collect())) == mails and len(mails) == 8


def test_every_attacked_address_is_counted(spark, folder):
    want = brute(TEXTS)
    short, scores = {}, {}
    for attack in spans.ATTACKS:
        marked = [(t, [(a, b) for a, b, _ in m], m) for (_, k), (t, m) in want.items() if k == attack]
        gold = [s for _, g, _ in marked for s in g]
        found = [[m.span() for m in re.finditer(MAIL, t)] for t, *_ in marked]
        tp = sum(s in f for (_, g, _), f in zip(marked, found) for s in g)
        fp, fn = sum(map(len, found)) - tp, len(gold) - tp
        eligible = sum(c for *_, m in marked for *_, c in m)
        lost = sum(c and (a, b) not in f for (*_, m), f in zip(marked, found) for a, b, c in m)
        scores[attack] = ("scored", len(marked), tp, fp, fn, 2 * tp / (2 * tp + fp + fn), eligible, lost) if marked else ("no_applicable_entities", *[None] * 7)
        values = [t[a:b] for t, _, m in marked for a, b, c in m if c]
        short[attack] = (len(values), sum(not re.fullmatch(MAIL, v) for v in values))
    got = {r["attack"]: tuple(r[c] for c in ("status", "records", "tp", "fp", "fn", "f1", "eligible", "lost")) for r in query("i07_attack_scores")(spark, folder).collect()}
    assert got == scores and {a for a, x in scores.items() if x[0] != "scored"} == {"whitespace", "phone_formatting"}
    got = {r["attack"]: (r["changed"], r["missed"]) for r in query("i07_attack_robustness")(spark, folder).collect()}
    assert got == {a: short[a] for a in ("email_obfuscation", "character_substitution")}


def test_budget_keeps_anchors(spark):
    df = spark.createDataFrame([(i, 10, i >= 98) for i in range(100)], "rank long, cost long, rare boolean")
    got = corpus.budget_prefix(df, "rank", "cost", 45, F.col("rare")).collect()
    assert sorted((r["rank"], r["spent"]) for r in got) == [(0, 30), (1, 40), (98, 10), (99, 20)]
    assert corpus.budget_prefix(df, "rank", "cost", 20, F.col("rare")).count() == 2
    with pytest.raises(ValueError):
        corpus.budget_prefix(df, "rank", "cost", 19, F.col("rare"))


def test_budget_sums_in_more_than_one_task(spark, capsys):
    costs = [None if i % 4 == 0 else i % 7 for i in range(9000)]
    df = spark.createDataFrame(list(enumerate(costs)), "id long, cost long").repartition(7)
    got = corpus.budget_prefix(df, "id", "cost", 20000)
    want, spent = {}, None
    for i, c in enumerate(costs):
        spent = spent if c is None else (spent or 0) + c
        if spent is not None and spent <= 20000:
            want[i] = spent
    assert {r["id"]: r["spent"] for r in got.collect()} == want
    capsys.readouterr()
    got.explain()
    assert "Window [sum(_cost" in (plan := capsys.readouterr().out) and "[_pid" in plan.split("Window [sum(_cost", 1)[1].split("\n")[0]
