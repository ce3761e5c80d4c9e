"""Incremental activity and late audio against their batch twins under random cuts."""

import datetime
import random

import pytest

from parley.streaming import activity, capture, sources
from parley.streaming.replay import replay

AT = datetime.datetime(2024, 1, 1)


def at(sample):
    return AT + datetime.timedelta(seconds=sample / 16000)


@pytest.mark.parametrize("seed", [1, 2])
def test_activity_equals_the_batch_sweep(spark, seed):
    """Turns come at any step; what was observed before is settled."""
    sources.use_rocksdb(spark)
    r, steps, turns, observed = random.Random(seed), [[], [], [], []], [], []
    marks = {k: sorted(r.sample(range(1000, 9000), 3)) + [10_000] for k in range(4)}
    for k, ends in marks.items():
        for _ in range(40):
            a = r.randrange(10_000)
            z, step = a + r.choice([0, 50, 400, 3000]), r.randrange(4)
            turns.append((k, f"speaker_{r.randrange(3)}", a, z, ends[step - 1] if step else 0))
            steps[step].append((k, "system", "turn", turns[-1][1], a, z, at(ends[step])))
        for step, end in enumerate(ends):
            steps[step].append((k, "system", "observed" if step < 3 else "end", None, None, end, at(end)))
        observed.append((k, ends[-1]))
    steps[3] += [(9, "system", "turn", "speaker_1", None, 5, at(0)), (9, "system", "other", None, 1, 5, at(0)), (None, "system", "end", None, None, 5, at(0))]
    found = replay([spark.createDataFrame(s, activity.ROWS) for s in steps], lambda x: activity.live(x.withWatermark("at", "1 second")))
    want = activity.activity_regions(spark.createDataFrame(turns, "recording_id long, speaker string, start_sample long, end_sample long, known_from long"), spark.createDataFrame(observed, "recording_id long, end_sample long"))
    got = activity.closed_regions(found)
    assert got.count() == found.where("final").count()
    rows = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == rows and len(rows) > 40


def test_idle_sources_end(spark):
    sources.use_rocksdb(spark)
    first = [(1, "system", "turn", "speaker_0", 0, 500, at(0)), (1, "system", "observed", None, None, 800, at(0)), (2, "system", "observed", None, None, 100, at(0))]
    later = [(2, "system", "observed", None, None, 200, at(16_000 * 120))]
    last = [(2, "system", "end", None, None, 300, at(16_000 * 121))]
    found = replay([spark.createDataFrame(s, activity.ROWS) for s in (first, later, last)], lambda x: activity.live(x.withWatermark("at", "1 second")))
    got = sorted((x.recording_id, x.start_sample, x.end_sample, x.owners) for x in activity.closed_regions(found).collect())
    assert got == [(1, 0, 500, "speaker_0"), (1, 500, 800, ""), (2, 0, 300, "")]


def test_sweep():
    assert activity.sweep([("b", 2, 6), ("a", 4, 9), ("a", 5, 7), ("c", 3, 3)], 0, 8) == [(0, 2, ""), (2, 4, "b"), (4, 6, "a,b"), (6, 8, "a")]
    assert activity.sweep([("a", 0, 9)], 5, 5) == []


def packet(k, source, start, frames, ms, ended=False):
    return (k, source, start, frames, ms, ended, AT + datetime.timedelta(milliseconds=ms))


@pytest.mark.parametrize("seed", [1, 2])
def test_late_audio_equals_the_batch_twin(spark, seed):
    sources.use_rocksdb(spark)
    r, rows, ends = random.Random(seed), [], []
    for k in range(3):
        for n in range(60):
            for s in sources.SOURCES:
                if r.random() < 0.8:
                    came = n * 100 + 100 + r.choice([0, 0, 0, 30, 700, 2000])
                    rows.append(packet(k, s, n * 1600, 1600, came))
        ends.append((k, 8_333))
    steps = [[x for x in rows if x[4] <= 2000], [x for x in rows if 2000 < x[4] <= 4100], [x for x in rows if x[4] > 4100] + [packet(k, None, None, None, ms, True) for k, ms in ends]]
    for step in steps:
        r.shuffle(step)
    found = replay([spark.createDataFrame(s, capture.PACKETS) for s in steps], lambda x: capture.live(x.withWatermark("at", "500 milliseconds")))
    packets = spark.createDataFrame(rows, capture.PACKETS)
    tiles = sorted(map(tuple, capture.tiles(packets, spark.createDataFrame(ends, "recording_id long, clock_ms long")).collect()))
    assert sorted((x.recording_id, x.source_id, x.start_sample, x.samples) for x in found.where("kind = 'tile'").collect()) == tiles
    want = {x.recording_id: (x.late, x.repaired_from) for x in capture.repairs(packets).collect()}
    got = {k: (found.where(f"kind = 'late' AND recording_id = {k}").count(), min(x.start_sample for x in found.where(f"kind = 'repair' AND recording_id = {k}").collect())) for k in want}
    assert got == want and len(want) == 3
    late = sorted((x.recording_id, x.source_id, x.start_sample, x.late) for x in capture.late(packets).where("late > 0").collect())
    assert sorted((x.recording_id, x.source_id, x.start_sample, x.samples) for x in found.where("kind = 'late'").collect()) == late


def test_the_repair_point_moves_back(spark):
    rows = [packet(1, "system", 0, 16_000, 400), packet(1, "system", 9_000, 100, 3000), packet(1, "system", 5_000, 100, 3100), packet(1, "system", 39_990, 100, 3200)]
    got = {x.recording_id: x.repaired_from for x in capture.repairs(spark.createDataFrame(rows, capture.PACKETS)).collect()}
    assert got == {1: 4_000}
    late = [x.late for x in capture.late(spark.createDataFrame(rows, capture.PACKETS)).orderBy("clock_ms").collect()]
    assert late == [0, 100, 100, 10]
