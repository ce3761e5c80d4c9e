"""Mergeable evidence under random cuts and trees; solo ranges, clips and channel matches with literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import admissions, voices

FRAMES = "recording_id long, start_sample long, end_sample long, p100 long, constant_block boolean, observed boolean, policy string"


@pytest.mark.parametrize("seed", [1, 2])
def test_merging_in_any_order(spark, seed):
    r = random.Random(seed)
    rows = [(k, i * 512, i * 512 + 512, r.choice([5, 20, 40, 60, 90]) if (i // 20) % 2 else 10, r.random() < 0.1, r.random() < 0.9, "a" if k else r.choice("ab")) for k in range(3) for i in range(200)]
    frames = spark.createDataFrame(rows, FRAMES)
    look = lambda df: sorted(map(tuple, df.select("recording_id", "start_sample", "end_sample", "complete", "maximum", "model_maximum", "policy", *admissions.KINDS, admissions.decision()).collect()))
    whole = look(admissions.parts(frames, 1 << 40))
    assert [x[:4] for x in whole] == [(k, 0, 102_400, True) for k in range(3)] and whole[0][5:7] == (None, None) and whole[1][6] == "a"
    for size in (512, 3000, 40_000):
        small = admissions.parts(frames, size)
        assert look(admissions.merge(small)) == whole
        cuts = sorted(r.sample(range(102_400), 3))
        tree = F.lit(0)
        for c in cuts:
            tree = tree + (F.col("start_sample") >= c).cast("int")
        assert look(admissions.merge(admissions.merge(small.withColumn("branch", tree), ["branch"]))) == whole
    broken = admissions.merge(admissions.parts(frames.where("start_sample <> 51200"), 5000))
    assert {x.d for x in broken.select(admissions.decision().alias("d")).collect()} == {"pending"}


PASSAGE = {"recording_id": 1, "passage_id": "p", "track": "speaker_0", "speaker": "speaker_0", "start_sample": 0, "end_sample": 100, "utterance_id": "p", "canonical_state": "sealed", "finalized": True, "separated": False, "audio_state": None, "unresolved": None, "candidates": ["speaker_0"], "source_candidates": ["speaker_0"], "protected": "text", "audio_revision": 2, "activity_revision": 2, "observed_end": 90, "regions": [(0, 20, ["speaker_0"]), (20, 30, ["speaker_0"]), (30, 50, []), (50, 90, ["speaker_0"])]}
SCHEMA = "recording_id long, passage_id string, track string, speaker string, start_sample long, end_sample long, utterance_id string, canonical_state string, finalized boolean, separated boolean, audio_state string, unresolved string, candidates array<string>, source_candidates array<string>, protected string, audio_revision int, activity_revision int, observed_end long, regions array<struct<start_sample: long, end_sample: long, speakers: array<string>>>"


def test_solo_ranges(spark):
    cases = [({}, [(0, 30), (50, 90)]), ({"speaker": "unassigned"}, [(0, 30), (50, 90)]), ({"utterance_id": None, "regions": None}, [(0, 100)])]
    cases += [(c, []) for c in ({"separated": True}, {"audio_state": "x"}, {"unresolved": "x"}, {"speaker": "speaker_1"}, {"candidates": ["speaker_0", "speaker_1"]}, {"source_candidates": None}, {"protected": "text,start"}, {"activity_revision": 1}, {"observed_end": 0}, {"observed_end": 101}, {"observed_end": 91}, {"canonical_state": "open"}, {"finalized": None}, {"utterance_id": "q"}, {"utterance_id": None, "speaker": "unassigned"}, {"track": "guest", "speaker": "guest", "candidates": ["guest"], "source_candidates": ["guest"]}, {"regions": []},
        {"regions": [(0, 20, ["speaker_0"]), (21, 90, [])]}, {"regions": [(1, 90, ["speaker_0"])]}, {"regions": [(0, 50, ["speaker_0"]), (50, 90, ["speaker_1"])]}, {"regions": [(0, 90, ["speaker_0", "speaker_1"])]}, {"regions": [(0, 0, []), (0, 90, ["speaker_0"])]})]
    rows = spark.createDataFrame([tuple((PASSAGE | {"recording_id": k} | c).values()) for k, (c, _) in enumerate(cases)], SCHEMA)
    got = {}
    for x in voices.solo_ranges(rows).collect():
        got.setdefault(x.recording_id, []).append((x.start_sample, x.end_sample))
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, (_, want) in enumerate(cases) if want}


def test_clips(spark):
    p = spark.createDataFrame([(1, k, 0, z) for k, z in (("a", 32_000), ("b", 31_999), ("c", 160_000), ("d", 160_001), ("e", 300_000))], "recording_id long, passage_id string, start_sample long, end_sample long")
    got = voices.clip_choices(p.withColumn("track", F.lit("speaker_0")), p).collect()
    assert sorted((x.clip_id, x.start_sample, x.end_sample) for x in got) == [("a", 0, 32_000), ("c", 0, 160_000), ("d@0:96000", 0, 96_000), ("d@96000:160001", 96_000, 160_001), ("e@0:96000", 0, 96_000), ("e@192000:288000", 192_000, 288_000), ("e@96000:192000", 96_000, 192_000)]


def test_channels(spark):
    def ask(channels, references, threshold=0.7, margin=0.1):
        c = spark.createDataFrame([(1, "e", k, v) for k, v in channels], "recording_id long, episode string, channel int, vector array<float>")
        r = spark.createDataFrame([(1, *x) for x in references], "recording_id long, target string, person_id string, centroid array<float>")
        return {x.channel: (x.target, round(x.score, 6), round(x.margin, 6)) for x in voices.channel_matches(c, r, threshold, margin).collect()}

    a, b, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.99, 0.14, 0.0]
    refs = [("t0", None, a), ("t1", None, b)]
    assert ask([(0, [2.0, 0.0, 0.0]), (1, b)], refs) == {0: ("t0", 1.0, 1.0), 1: ("t1", 1.0, 1.0)}
    assert ask([(0, a), (1, a)], refs) == {}
    # a track of a person and the person's profile are one identity: no runner-up, and both channels on it annul each other
    assert ask([(0, a)], [("t0", "ann", a), ("p", "ann", near)])[0][0] == "t0"
    assert ask([(0, a)], [("t0", "ann", a), ("p", "bob", near)]) == {}
    assert ask([(0, a), (1, near)], [("t0", "ann", a), ("p", "ann", near)]) == {}
    # the lowest score counts against the threshold, the mean against the margin
    assert ask([(0, a), (0, [1.0, 1.2, 0.0])], refs) == {}
    assert ask([(0, [0.8, 0.6, 0.0])], refs, 0.7, 0.21) == {} and ask([(0, [0.8, 0.6, 0.0])], refs, 0.7, 0.19) == {0: ("t0", 0.8, 0.2)}
    assert ask([(0, a)], [("t0", None, [0.5, 0.86, 0.0])]) == {}
