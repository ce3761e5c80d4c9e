"""Literal rows whose results are fixed by the rules themselves, in samples at 16 kHz, and ordered passes against plain Python."""

import pytest
from pyspark.sql import functions as F

from parley import catalog
from parley.functions import scalars
from parley.operators import changes, folds, identity, intervals, language, ranges, review, speech, transcript

SPAN = "recording_id long, start_sample long, end_sample long"


def test_crops_reach_half_way_to_neighbours_and_bounds(spark):
    two = spark.createDataFrame([(1, 1600, 16000), (1, 64000, 80000), (2, 2000, 10000), (3, 2000, 19000)], SPAN)
    length = spark.createDataFrame([(1, 192000), (2, 20000), (3, 20000)], "recording_id long, duration long")
    got = {(x[0], x[1]): (x.audio_start, x.audio_end) for x in intervals.crop_padding(two, length).collect()}
    assert got == {(1, 1600): (800, 19520), (1, 64000): (60480, 83520), (2, 2000): (1000, 13520), (3, 2000): (1000, 19500)}


def test_equal_spans_make_one_island(spark):
    """Both copies of a span belong to the island that the first of them begins, never to the one before."""
    rows = [(r, *x) for r in range(50) for x in [(0, 100), (200, 300), (200, 300), (200, 300), (250, 400)]]
    got = sorted(tuple(x) for x in intervals.islands(spark.createDataFrame(rows, SPAN).repartition(7)).collect())
    assert got == [(r, *x) for r in range(50) for x in [(0, 100), (200, 400)]]


def test_ids_of_uncovered_audio_count_all_ids(spark):
    p = spark.createDataFrame([(1, "a", 16000, 32000), (1, "unassigned-3", 32000, 40000), (1, "unassigned-3-gap", 40000, 48000)], "recording_id long, passage_id string, start_sample long, end_sample long")
    d = spark.createDataFrame([(1, 64000)], "recording_id long, duration long")
    assert sorted((x.passage_id, x.start_sample) for x in intervals.uncovered_rows(p, d).collect()) == [("unassigned-3-gap-gap", 0), ("unassigned-4", 48000)]


@pytest.mark.parametrize(
    ("text", "name"),
    [("I'm Priya. Welcome to the meeting.", "Priya"), ("Priya, what do you think?", ""), ("  hey! i’m  Jean-Luc  Picard and", "Jean-Luc Picard"), ("MY NAME IS Ana", "Ana"), ("I am late today.", ""), ("Hello, I am O'Neil Ñandú Émile Xu", "O'Neil Ñandú Émile")],
)
def test_introduced_names(spark, text, name):
    assert spark.createDataFrame([(text,)], "t string").select(transcript.introduced_name(F.col("t"))).first()[0] == name


def state(**own):
    row = {"recording_id": 1, "passage_id": "p", "text": "words", "speaker": "speaker_0", "separated": False, "resolution": None, "review_code": None, "detection_mode": None, "detection_reason": None, "language": "en"} | own
    return tuple(row.values())


@pytest.mark.parametrize(
    ("own", "reason", "marked"),
    [
        ({}, None, "words"),
        ({"text": "", "speaker": "unassigned"}, review.EMPTY, f"[Needs review: {review.EMPTY}]"),
        ({"speaker": "unassigned"}, "Speaker uncertain", "words [Needs review: Speaker uncertain]"),
        ({"speaker": "multiple_speakers"}, review.MULTIPLE, None),
        ({"separated": True}, "Separated voice estimate; check words and speaker", None),
        ({"separated": True, "resolution": "words_reviewed"}, None, "words"),
        ({"review_code": "token_limit", "speaker": "overlap_1"}, review.REASONS["token_limit"], None),
        ({"detection_mode": "auto", "detection_reason": "best_effort"}, review.REASONS["best_effort"], None),
        ({"detection_mode": "auto", "detection_reason": "odd", "language": None}, review.UNCERTAIN, None),
    ],
)
def test_review_reasons(spark, own, reason, marked):
    d = spark.createDataFrame([state(**own)], "recording_id long, passage_id string, text string, speaker string, separated boolean, resolution string, review_code string, detection_mode string, detection_reason string, language string")
    got = review.review(d).first()
    assert got.reason == reason and (marked is None or got.marked == marked)


def test_frames_without_observation_are_uncertain(spark):
    f = [(1, 0, 512, 10, False, False), (1, 512, 1024, 40, False, True), (2, 0, 512, 40, True, True), (3, 0, 512, 90, False, False)]
    got = {x.recording_id: (x.speech, x.uncertain, x.negative_constant, x.model_negative, x.decision) for x in speech.inspection(spark.createDataFrame(f, SPAN + ", p100 int, constant_block boolean, observed boolean")).collect()}
    assert got == {1: (0, 512, 0, 512, "uncertain"), 2: (0, 0, 512, 0, "no_speech"), 3: (512, 0, 0, 0, "speech")}


def test_admission_needs_unbroken_frames(spark):
    f = [(1, i * 512, i * 512 + 512, 90 if i in (2, 3) else 10, False) for i in range(6) if i != 4]
    ranges_ = spark.createDataFrame([(1, 1, 100, 1500), (1, 2, 1100, 1900), (1, 3, 1600, 2200), (1, 4, 0, 900)], "recording_id long, span_id long, start_sample long, end_sample long")
    got = {x.span_id: (x.complete, x.speech, x.decision) for x in speech.admission(ranges_, spark.createDataFrame(f, SPAN + ", p100 int, constant_block boolean")).collect()}
    assert got == {1: (True, "1024-1500", "speech"), 2: (True, "1100-1900", "speech"), 3: (False, None, "pending"), 4: (True, "", "no_speech")}


def test_mixed_languages_need_review(spark):
    p = [(1, 1, 0, 48000, "en", 95, 0, True, False), (1, 2, 48000, 96000, "de", 96, 0, True, False), (2, 3, 0, 48000, "en", 95, 0, True, True), (3, 4, 0, 48000, "sw", 95, 0, True, False)]
    d = spark.createDataFrame(p, "recording_id long, probe_id long, start_sample long, end_sample long, top_code string, top_pct int, second_permille int, text_ok boolean, detector_error boolean")
    got = {x.recording_id: (x.mixed, x.unknown, x.review, x.language, x.reason, x.detector_error) for x in language.summary(d).collect()}
    assert got == {1: (True, False, True, None, "mixed", False), 2: (False, False, False, "en", "detected", True), 3: (False, True, True, None, "unsupported", False)}


def test_every_clip_must_reach_the_threshold(spark):
    ranked = spark.createDataFrame([("t", "a", 0.5, 0.0, 2, 1), ("u", "a", 0.9, 0.8, 2, 1), ("u", "b", 0.88, 0.8, 2, 2), ("v", "a", 0.9, 0.8, 2, 1), ("w", "a", 0.9, 0.8, 1, 1)], "track_id string, person_id string, mean double, least double, clips long, place int")
    assert {x.track_id: (x.person_id, x.outcome) for x in identity.decide(ranked, 0.6, 0.05).collect()} == {"t": (None, "below_threshold"), "u": (None, "small_margin"), "v": ("a", "matched"), "w": (None, "few_clips")}


def test_ledgers_start_at_zero(spark):
    d = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (2, 5, 20), (3, 0, 10), (3, 11, 20)], SPAN)
    bound = spark.createDataFrame([(1, 20), (2, 20), (3, 20)], "recording_id long, duration long")
    assert {x.recording_id: x.contiguous for x in ranges.contiguous(d, bound).collect()} == {1: True, 2: False, 3: False}


def test_short_interruptions_are_bridged():
    s = lambda x: int(x * 16000)
    assert folds.bridge([(0, s(2.5), "a"), (s(2.5), s(3), "a,b"), (s(3), s(6), "b"), (s(6), s(9), "c")]) == [(0, s(2.5), "a", 1), (s(2.5), s(3), "a,b", 1), (s(3), s(6), "b", 1), (s(6), s(9), "c", 1)]
    assert folds.bridge([(0, s(1), "a"), (s(1), s(1.25), ""), (s(1.25), s(2.25), "a"), (s(2.25), s(2.5), ""), (s(2.5), s(3.5), "a")]) == [(0, s(3.5), "a", 5)]
    assert len(folds.bridge([(0, s(1), "a"), (s(1), s(2), ""), (s(2), s(3), "a")])) == 3
    assert folds.bridge([(0, s(1), "a"), (s(1), s(1.3), "a,b"), (s(1.3), s(2), "a")]) == [(0, s(2), "a,b", 3)]


def test_cut_plans_move_to_verified_gaps():
    assert folds.cut_plan(0, 320_000, []) == [] and folds.cut_plan(0, 400_000, []) == [(200_000, False)]
    assert folds.cut_plan(0, 400_000, [(205_000, 209_000, True), (199_000, 203_000, False)]) == [(207_000, True)]
    assert folds.cut_plan(0, 400_000, [(205_000, 206_000, True), (230_000, 240_000, True)]) == [(200_000, False)]


def test_regimes_need_three_matches_that_agree():
    delays = [0, 1, 0, 100, 101, 0, 100, 100, 101, 100]
    assert [c for _, c in folds.regimes([(float(i), float(x)) for i, x in enumerate(delays)])] == [0, 0, 0, 0, 0, 0, 0, 0, 1, 1]
    assert folds.regimes([(float(i), 0.0) for i in range(20)])[-1] == (12, 0)


def test_clips_are_disjoint_or_none():
    assert folds.earliest_end([(0, 10), (5, 8), (8, 12), (12, 20)], 3) == [(5, 8), (8, 12), (12, 20)]
    assert folds.earliest_end([(0, 10), (5, 12)], 2) == []


def test_ordered_queries_equal_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    cells = intervals.coalesce_equal(intervals.elementary(catalog.view(spark, sf, "turns"))).collect()
    want = []
    for k in {x.recording_id for x in cells}:
        want += [(k, *x) for x in folds.bridge(sorted((x.start_sample, x.end_sample, x.owners) for x in cells if x.recording_id == k))]
    assert sorted(tuple(x) for x in catalog.queries()["w5_decode_regions"](spark, sf).collect()) == sorted(want)
    for name in ("v3_w12_chosen_clips", "g7_cut_plans", "w16_regime_changes"):
        assert catalog.queries()[name](spark, sf).count() > 0
    for x in catalog.queries()["g7_cut_plans"](spark, sf).collect():
        assert x.start_sample < x.cut < x.end_sample


def test_empty_text_never_replaces_words(spark):
    prior = spark.createDataFrame([(1, "a", "x", "s", 0, 9, "", False, False), (1, "b", "y", "s", 0, 9, "text", False, False), (1, "c", "z", "s", 0, 9, "", True, False)], "recording_id long, passage_id string, text string, speaker string, start_sample long, end_sample long, protected string, deleted boolean, refined boolean")
    new = spark.createDataFrame([(1, "a", " ", "t", 1, 8), (1, "b", "other", "t", 1, 8), (1, "c", "other", "t", 1, 8), (1, "d", "new", "t", 1, 8)], "recording_id long, passage_id string, text string, speaker string, start_sample long, end_sample long")
    assert {x.passage_id: (x.text, x.speaker, x.origin) for x in changes.live_merge(prior, new).collect()} == {"a": ("x", "t", "merged"), "b": ("y", "t", "merged"), "c": ("z", "s", "kept"), "d": ("new", "t", "new")}


def test_clock_and_softmax(spark):
    row = spark.createDataFrame([([1.0, 9.0, 1.0],)], "v array<double>").select(scalars.review_clock(F.lit(16000 * 61 + 8).cast("long")), scalars.masked_softmax(F.col("v"), F.array(F.lit(0), F.lit(2)))).first()
    assert row[0] == "01:01.0005" and row[1] == [0.5, 0.5]
