"""License scan against plain counting and the plain definition of suppression."""

import random
import re

from parley.llm import licenses, queries

SF = "/root/testdata/sf0.001"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text):
    """Base places by comparing word lists at every start."""
    raw = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)]
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_query_counts_all_places(spark):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op1_license_scan(spark, SF).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == plain(texts[x.doc_id])
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1


def test_overlapping_and_repeated_mentions():
    text = "Under the MIT license under the mit LICENSE; cc-by-nc cc by nc by nc. é日本"
    got = licenses.scan_text(text)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == plain(text)


def test_rules_have_keywords_of_their_own_matches():
    assert len(licenses.rules()) > 400 and all(r.keyword for r in licenses.rules())
    for lines in licenses.SIGNATURES.values():
        for line in lines.split("\n"):
            if line.strip() and not re.search(r"[\[\]().?{|]", line):
                found = {r.name for r, _, _ in licenses.candidates(f" a {line.strip()} b ")}
                assert any(":signature:" in x for x in found), line


def test_settling_is_by_priority_and_containment():
    rules, r = licenses.rules(), random.Random(1)
    for _ in range(200):
        found = [(r.choice(rules), a, a + r.randint(1, 30)) for a in (r.randint(0, 60) for _ in range(r.randint(0, 40)))]
        kept = []
        for rule, a, b in sorted(found, key=lambda x: (-x[0].priority, x[1] - x[2], x[1], x[0].name)):
            if not any(c <= a and b <= d for _, c, d in kept):
                kept.append((rule, a, b))
        assert [(x.name, a, b) for x, a, b in licenses.settle(found)] == [(x.name, a, b) for x, a, b in kept]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
