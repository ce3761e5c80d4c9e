"""Documents as stored: rejects, rows, rules and the printed form, with literal payloads."""

import json

from pyspark.sql import functions as F

from parley.operators import documents as d

GOLDEN = {"speakers": {"speaker_0": " Ada Lovelace "}, "segments": [{"id": "later", "start": 4.0, "end": 5.5, "speaker": "speaker_0", "text": "Second line."}, {"id": "earlier", "start": 0.5, "end": 2.25, "speaker": "speaker_0", "text": "Hello, oracle."}]}


def payloads(spark, *rows):
    return spark.createDataFrame([(k, x if x is None or isinstance(x, str) else json.dumps(x)) for k, x in enumerate(rows)], "recording_id long, payload string")


def test_rejects(spark):
    found = d.parsed(payloads(spark, GOLDEN, None, "  \n", "{", "[1]", {"id": "5"}, {"id": 6}, {"id": "x"}, '"text"', {"id": 9, "speakers": {}}))
    assert {r.recording_id: r.reject for r in found.collect()} == {0: None, 1: "empty", 2: "empty", 3: "bad_json", 4: "not_an_object", 5: None, 6: None, 7: "other_id", 8: "not_an_object", 9: None}
    assert d.accepted(found).count() == 4 and d.rejected(found).count() == 6


def test_rows(spark):
    doc = {"speakers": {"b": "  Bea\n", "n": 7}, "segments": [{"start": "1.5", "end": 2, "speaker": "b", "text": "x", "new": {"deep": [1]}}, {"id": 4, "start": True, "end": None, "speaker": 1}, "odd"]}
    docs = d.accepted(d.parsed(payloads(spark, doc)))
    got = d.passages(docs).orderBy("pos").collect()
    assert [(x.passage_id, x.start, x.end, x.speaker, x.text, x.is_object) for x in got] == [("seg-0", 1.5, 2.0, "b", "x", True), (None, None, None, None, None, True), ("seg-2", None, None, None, None, False)]
    assert d.passages(docs).select(F.try_variant_get("segment", "$.new.deep[0]", "long").alias("x")).where("x = 1").count() == 1
    assert sorted(map(tuple, d.speakers(docs).collect()), key=str) == [(0, "b", "Bea"), (0, "n", None)]


def first_rule(spark, doc, duration=10.0):
    docs = d.accepted(d.parsed(payloads(spark, doc)))
    got = d.violations(docs, spark.createDataFrame([(0, duration)], "recording_id long, duration double")).collect()[0]
    return got.rule, got.pos


def test_rules(spark):
    base = GOLDEN["segments"][0]
    seg = lambda **c: {**GOLDEN, "segments": [base, {**base, "id": "two", **c}]}
    cases = [
        (GOLDEN, (None, None)), (seg(), (None, None)), (seg(end=10.001), (None, None)), (seg(end=10.002), ("segment_bounds", 1)), (seg(start=-0.1), ("segment_bounds", 1)), (seg(start=5.5), ("segment_bounds", 1)),
        (seg(start="4.5"), (None, None)), (seg(start="x"), ("segment_times", 1)), (seg(end=None), ("segment_times", 1)), (seg(end=True), ("segment_times", 1)), (seg(speaker="gone"), ("speaker_or_text", 1)), (seg(text=5), ("speaker_or_text", 1)),
        (seg(text="x" * 20_000), (None, None)), (seg(text="x" * 20_001), ("speaker_or_text", 1)), (seg(id="later"), ("segment_ids", 1)), (seg(id=3), ("segment_ids", 1)), (seg(id="i" * 101), ("segment_ids", 1)),
        ({**GOLDEN, "segments": [base, 3]}, ("segment_object", 1)), ({**GOLDEN, "segments": {}}, ("segment_list", None)), ({"speakers": {"a": "A"}}, ("segment_list", None)), ({"segments": []}, ("speaker_count", None)),
        ({"speakers": {}, "segments": []}, ("speaker_count", None)), ({"speakers": {f"s{i}": "n" for i in range(65)}, "segments": []}, ("speaker_count", None)), ({"speakers": {f"s{i}": "n" for i in range(64)}, "segments": []}, (None, None)),
        ({"speakers": {"a": "  "}, "segments": []}, ("speaker_names", None)), ({"speakers": {"a": 1}, "segments": []}, ("speaker_names", None)), ({"speakers": {"a": "n" * 101}, "segments": []}, ("speaker_names", None)), ({"speakers": {"k" * 81: "n"}, "segments": []}, ("speaker_names", None)),
    ]
    docs = d.accepted(d.parsed(payloads(spark, *(x for x, _ in cases))))
    durations = docs.select("recording_id", F.lit(10.0).alias("duration"))
    assert {r.recording_id: (r.rule, r.pos) for r in d.violations(docs, durations).collect()} == {k: want for k, (_, want) in enumerate(cases)}


def test_printed(spark):
    body = '{\n  "speakers": {\n    "speaker_0": "Ada Lovelace"\n  },\n  "segments": [\n    {\n      "id": "earlier",\n      "start": 0.5,\n      "end": 2.25,\n      "speaker": "speaker_0",\n      "text": "Hello, oracle."\n    },\n    {\n      "id": "later",\n      "start": 4.0,\n      "end": 5.5,\n      "speaker": "speaker_0",\n      "text": "Second line."\n    }\n  ],\n  "schema_version": 1\n}\n'
    odd = {"speakers": {"s": "Zoë"}, "unknown": {"kept": []}, "segments": [{"id": "gone", "start": 0, "end": 1, "speaker": "s", "text": "", "deleted": True}, {"mine": {}, "id": "a", "start": 1, "end": 2, "speaker": "s", "text": "日本\t\"x\"", "separation_candidate": {"a": 1}, "language": "ja"}]}
    got = {r.recording_id: r.body for r in d.as_json(payloads(spark, GOLDEN, odd)).collect()}
    assert got[0] == body
    assert got[1] == '{\n  "speakers": {\n    "s": "Zoë"\n  },\n  "segments": [\n    {\n      "id": "a",\n      "start": 1.0,\n      "end": 2.0,\n      "speaker": "s",\n      "text": "日本\\t\\"x\\"",\n      "language": "ja",\n      "mine": {}\n    }\n  ],\n  "schema_version": 1,\n  "unknown": {\n    "kept": []\n  }\n}\n'


def test_lookup(spark):
    rows = [(1, "ready", {"segments": [{"text": "x", "protected_fields": ["text"]}, {"text": "y"}]}), (2, "ready", {"segments": [{"text": "x", "protected_fields": ["text"]}, {"text": " "}]}), (3, "failed", {"segments": [{"text": "y"}]}), (4, "ready", {})]
    stored = spark.createDataFrame([(i, f"n{i}", s, json.dumps(x), "private") for i, s, x in rows], "recording_id long, name string, status string, payload string, extra string").withColumn("document", F.parse_json("payload")).drop("payload")
    got = {r.recording_id: (r.name, r.extra, r.refinable) for r in d.lookup(stored, [1, 2, 3, 4, 9], metadata=True).drop("document").collect()}
    assert got == {1: ("n1", None, True), 2: ("n2", None, False), 3: ("n3", None, False), 4: ("n4", None, False)}
    assert d.lookup(stored, [2]).select("extra").collect()[0].extra == "private"
