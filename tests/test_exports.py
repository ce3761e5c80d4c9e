"""Exports with literal rows: what is written, in which order, and up to which size."""

from pyspark.sql import functions as F

from parley.functions import scalars
from parley.operators import exports, reading

STATE = "recording_id long, passage_id string, start_sample long, end_sample long, speaker string, text string, deleted boolean, separated boolean, channel int, resolution string, review_code string, detection_mode string, detection_reason string, language string"


def states(spark, rows):
    return spark.createDataFrame([(1, i, a, z, who, text, deleted, separated, channel, None, None, "manual", None, "en") for i, a, z, who, text, deleted, separated, channel in rows], STATE)


def names(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "recording_id long, speaker string, name string")


def turns(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "recording_id long, passage_id string, n int, start_offset int, end_offset int, text string, speaker string, attribution string, start_sample long, end_sample long")


def body(spark, passages, speakers, told, kind, ids=((1,),)):
    return exports.export(passages, speakers, told, spark.createDataFrame(list(ids), "recording_id long"), kind).collect()[0].body


def test_two_lines(spark):
    """Out of order, half a second in: the golden document."""
    p = states(spark, [("later", 64000, 88000, "speaker_0", "Second line.", False, False, None), ("earlier", 8000, 36000, "speaker_0", "Hello, oracle.", False, False, None)])
    n, t = names(spark, [("speaker_0", "Ada Lovelace")]), turns(spark, [])
    assert body(spark, p, n, t, "txt") == "[00:00:00.500 – 00:00:02.250] Ada Lovelace: Hello, oracle.\n[00:00:04.000 – 00:00:05.500] Ada Lovelace: Second line.\n"
    assert body(spark, p, n, t, "srt") == "1\n00:00:00,500 --> 00:00:02,250\nAda Lovelace: Hello, oracle.\n\n2\n00:00:04,000 --> 00:00:05,500\nAda Lovelace: Second line.\n\n"
    assert body(spark, p, n, t, "vtt") == "WEBVTT\n\n1\n00:00:00.500 --> 00:00:02.250\nAda Lovelace: Hello, oracle.\n\n2\n00:00:04.000 --> 00:00:05.500\nAda Lovelace: Second line.\n\n"


def test_blank_and_deleted_rows_take_no_number(spark):
    p = states(spark, [("a", 0, 16000, "speaker_0", "gone", True, False, None), ("b", 16000, 32000, "speaker_0", "", False, False, None), ("c", 32000, 48000, "speaker_0", " 　", False, False, None), ("d", 48000, 64000, "speaker_0", "Checked café 日本語", False, False, None)])
    n, t = names(spark, [("speaker_0", "Zoë")]), turns(spark, [])
    assert body(spark, p, n, t, "srt") == "1\n00:00:03,000 --> 00:00:04,000\nZoë: Checked café 日本語\n\n"
    assert body(spark, p, n, t, "txt") == "[00:00:03.000 – 00:00:04.000] Zoë: Checked café 日本語\n"
    nothing = p.where("passage_id <> 'd'")
    assert [body(spark, nothing, n, t, k) for k in ("txt", "srt", "vtt")] == ["\n", "\n", "WEBVTT\n\n"]


def test_turns(spark):
    p = states(spark, [("one", 0, 16000, "multiple_speakers", "Hello there", False, False, None)])
    n = names(spark, [("multiple_speakers", "Multiple speakers"), ("speaker_0", "Ada"), ("speaker_1", "Bea")])
    known = turns(spark, [("one", 0, 0, 6, "Hello ", "speaker_0", "single", 0, 6400), ("one", 1, 6, 11, "there", "speaker_1", "single", 6400, 16000)])
    assert body(spark, p, n, known, "txt") == "[Coarse timing 00:00:00.000 – 00:00:00.400] Ada: Hello \n[Coarse timing 00:00:00.400 – 00:00:01.000] Bea: there\n"
    assert body(spark, p, n, known, "srt") == "1\n00:00:00,000 --> 00:00:00,400\nAda: Hello\n\n2\n00:00:00,400 --> 00:00:01,000\nBea: there\n\n"
    mixed = turns(spark, [("one", 0, 0, 6, "Hello ", "speaker_0", "single", 0, 6400), ("one", 1, 6, 11, "there", "unassigned", "unknown", None, None)])
    assert body(spark, p, n, mixed, "txt") == "[Coarse timing 00:00:00.000 – 00:00:00.400] Ada: Hello \n[Timing unknown; parent audio 00:00:00.000 – 00:00:01.000] Unknown speaker: there [Needs review: Speaker uncertain]\n"
    srt = body(spark, p, n, mixed, "srt")
    assert srt.count("-->") == 1 and "Multiple speakers: Hello there [Needs review: Multiple speakers; see localized turns where timing is available]" in srt


def test_subtitle_text_and_voices(spark):
    p = states(spark, [("one", 0, 16000, "speaker_0", "go\n--> next", False, False, None), ("two", 16000, 32000, "unassigned", "who", False, True, 1)])
    out = body(spark, p, names(spark, [("speaker_0", "A <B>")]), turns(spark, []), "srt")
    assert "A ‹B›: go → next\n" in out and "Voice B: who [Needs review: Separated voice estimate; check words and speaker]" in out


def test_size_limit_is_inclusive(spark, monkeypatch):
    p = states(spark, [("one", 0, 16000, "speaker_0", "abc", False, False, None)])
    n, t, ids = names(spark, [("speaker_0", "Z")]), turns(spark, []), spark.createDataFrame([(1,)], "recording_id long")
    size = exports.export(p, n, t, ids, "txt").collect()[0].bytes
    for least, allowed in ((size, True), (size - 1, False)):
        monkeypatch.setattr(exports, "LARGEST", least)
        got = exports.export(p, n, t, ids, "txt").collect()[0]
        assert (got.bytes, got.allowed, got.body is not None) == (size, allowed, allowed)


def test_canonical_order(spark):
    rows = [(1, "b", 0, 10, None, None, None, 2), (1, "a", 0, 10, "system", None, None, 3), (1, "c", 0, 10, "microphone_clean", None, None, 4), (1, "z", 0, 10, "other", "e1", 1, 0), (1, "y", 0, 10, None, "e1", 0, 1), (1, "x", 0, 5, "system", None, None, 9)]
    p = spark.createDataFrame(rows, "recording_id long, passage_id string, start_sample long, end_sample long, capture_source string, episode string, channel int, pos long")
    assert [r.passage_id for r in exports.ordered(p).orderBy("place").collect()] == ["x", "b", "y", "z", "c", "a"]


def test_receipts(spark):
    base = {"recording_id": 1, "passage_id": "one", "text": "Hello there", "start_sample": 0, "end_sample": 16000, "utterance_id": "one", "machine_revision": 1, "canonical_revision": 1, "audio_revision": 1, "language_epoch": 0, "capture_source": None, "anchor_start": 0, "anchor_end": 16000, "activity": "a", "protected": ""}
    kind = "recording_id long, passage_id string, text string, start_sample long, end_sample long, utterance_id string, machine_revision int, canonical_revision int, audio_revision int, language_epoch int, capture_source string, anchor_start long, anchor_end long, activity string, protected string"
    frame = lambda x: spark.createDataFrame([tuple(x.values())], kind)
    told = turns(spark, [("one", 0, 0, 6, "Hello ", "speaker_0", "single", 0, 6400), ("one", 1, 6, 11, "there", "speaker_1", "single", 6400, 16000)])
    given = reading.receipts(told, frame(base))
    assert reading.held(told, frame(base), given).count() == 2
    for change in ({"text": "Corrected"}, {"protected": "text"}, {"audio_revision": 2}, {"machine_revision": 2}, {"utterance_id": "two"}, {"language_epoch": 1}, {"capture_source": "system"}, {"anchor_end": 15000}, {"activity": "b"}):
        assert reading.held(told, frame(base | change), given).count() == 0, change
    assert reading.held(told.withColumn("speaker", F.lit("speaker_9")), frame(base), given).count() == 0
    assert reading.held(told, frame(base), given.unionByName(given)).count() == 0
    assert reading.held(told, frame(base), given.limit(0)).count() == 0


def test_file_names(spark):
    cases = {"a b.txt": "a_b.txt", "../up/ x　 y é-(1).md": "x_y_-1.md", "..hidden_file": "hiddenfile", "dir/": "dir", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "n string").select("n", scalars.safe_file_name(F.col("n")).alias("f")).collect()
    assert {r.n: r.f for r in got} == cases
