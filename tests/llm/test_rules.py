"""Quality rules against plain counting, and held-out accuracy of the classifier."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from parley.llm import queries, rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w in set(windows) if windows.count(w) > 1}
    repeats = sum(any(windows[k] in often for k in range(max(0, i - 2), min(i + 1, len(windows)))) for i in range(len(words)))
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, repeats, n < 50 or 100 * repeats > 50 * n


def docs(spark, rows):
    # a column whose name clashes with one that the operator adds
    return spark.createDataFrame([(*r, 0.0, "x") for r in rows], "doc_id long, text string, score double, kept string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def read(found):
    return [(x.doc_id, (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed)) for x in found.collect()]


def test_given_table(spark):
    texts = dict(duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = queries.op11_quality_rules(spark, SF).collect()
    assert sorted(x.doc_id for x in got) == sorted(texts)
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain(texts[x.doc_id])
        assert x.kept == (not x.base_failed and x.score >= rules.REJECT_BELOW) == (x.verdict in ("doubt", "good"))


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\v\f\r"), (4, "a b c " * 20), (4, "a b c " * 20), (None, "no id " * 30), (5, "x" * 300_000), (6, "é ü 日本 \x1c\x1d \U0001f600\n" * 9), (7, "\n".join(["same line", "same line ", "same line", "", ""] * 3)), (8, "a a a a"), (9, "a b a b a"), (10, "w " * 40_000)]
    found = rules.judge(docs(spark, rows), labels(spark, []))
    key = lambda x: repr(x)
    assert sorted(read(found), key=key) == sorted(((i, plain(t)) for i, t in rows), key=key)
    assert {x.score for x in found.collect()} == {rules.UNKNOWN}
    assert rules.judge(docs(spark, rows).limit(0), labels(spark, [(1, 1), (2, 0)])).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_counts_of_random_texts(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "b", "c", " ", " ", "\n", "#", "é", "\t"]) for _ in range(r.randrange(200)))
    codes, _ = rules.coded(text)
    assert rules.counts(text, codes) == plain(text)[:5]


def test_held_out_accuracy(spark):
    """Learns from labels of one half of the documents, and is judged on the other half, which no fit has seen."""
    sf = "/root/testdata/sf0.01"
    documents, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = lambda i: zlib.crc32(str(i).encode()) // 16 % 2 == 0
    truth = {x.doc_id: x.quality for x in known.collect()}
    model = rules.fit(documents, labels(spark, [(i, q) for i, q in truth.items() if half(i)]))
    got = {x.doc_id: x for x in rules.score(documents, model).collect()}
    judged = [(truth[i], x.score) for i, x in got.items() if i in truth and not half(i) and x.n_words >= 50]
    assert len(judged) > 100
    assert sum(s >= rules.REJECT_BELOW for q, s in judged if q) >= 0.98 * sum(q for q, _ in judged)
    assert sum(s < rules.REJECT_BELOW for q, s in judged if not q) >= 0.9 * sum(not q for q, _ in judged)


def test_labels_that_do_not_count(spark):
    rows = [(i, f"word{i} " * 60) for i in range(40)]
    assert rules.fit(docs(spark, rows), labels(spark, [(1, 1), (1, 0), (None, 0), (2, None), (3, 1), (99, 0)])) is rules.NOTHING
    hot = docs(spark, rows + [(1, "other text " * 30)] * 50)
    model = rules.fit(hot, labels(spark, [(i, i % 2) for i in range(40)]))
    assert model.known and np.isfinite(model.weights).all()
