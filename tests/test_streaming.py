"""The live utterances against their batch twin under random cuts, and rejected frames."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import speech
from parley.streaming import utterances
from parley.streaming.replay import current, replay


def frames_of(recordings, count, r):
    return [(k, i * 512, i * 512 + 512, r.choice([5, 20, 40, 60, 90]) if (i // 30) % 2 else 10, r.random() < 0.1, False) for k in range(recordings) for i in range(count)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_the_batch_result(spark, seed):
    r = random.Random(seed)
    data = frames_of(6, 150, r)
    frames = spark.createDataFrame(data, utterances.FRAMES)
    cuts = {k: sorted(r.randrange(150) for _ in range(2)) for k in range(6)}
    steps = [spark.createDataFrame([x for x in data if sum(x[1] >= c * 512 for c in cuts[x[0]]) == i], utterances.FRAMES) for i in range(3)]
    steps[2] = steps[2].unionByName(utterances.end_rows(frames))
    found = replay(steps, utterances.live_utterances)
    assert found.where("kind = 'rejected'").count() == 0
    got = current(found, ["recording_id", "n"])
    assert got.where("kind <> 'sealed'").count() == 0
    want = speech.utterances(frames)
    assert want.count() > 6
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_rejected_frames_change_nothing(spark):
    good = [(1, 0, 512, 90, False, False), (1, 512, 1024, 90, False, False)]
    bad = [(1, 0, 512, 90, False, False), (1, 4096, 4608, 90, False, False), (1, 1024, 1536, 300, False, False), (1, 1024, 1537, 90, False, False), (1, 9999, 9999, 0, False, True), (None, 0, 512, 90, False, False), (1, None, 512, 90, False, False)]
    end, after = [(1, 1024, 1024, 0, False, True)], [(1, 1024, 1536, 90, False, False)]  # within one micro-batch a frame goes before an end at its start
    found = replay([spark.createDataFrame(x, utterances.FRAMES) for x in (good, bad, end, after)], utterances.live_utterances)
    rejected = sorted((x.start_sample, x.reason) for x in found.where("kind = 'rejected'").collect())
    assert rejected == [(0, "late"), (1024, "closed"), (1024, "length"), (1024, "probability"), (4096, "gap"), (9999, "endpoint")]
    sealed = found.where("kind = 'sealed'").select("n", "start_sample", "end_sample").collect()
    assert [tuple(x) for x in sealed] == [(1, 0, 1024)]


def test_current_takes_the_newest(spark):
    rows = spark.createDataFrame([(1, 1, "open", 0), (1, 1, "sealed", 2), (1, 2, "open", 2)], "recording_id long, n long, kind string, batch int")
    assert sorted(map(tuple, current(rows, ["recording_id", "n"]).collect())) == [(1, 1, "sealed"), (1, 2, "open")]
    assert current(rows.where(F.lit(False)), ["recording_id", "n"]).count() == 0
