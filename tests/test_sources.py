"""Two live sources against their batch twin under random cuts, and rows that are refused."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import speech
from parley.streaming import sources
from parley.streaming.replay import replay_all

AT = datetime.datetime(2024, 1, 1)


def row(recording, kind, start, end=None, p=None, constant=None, epoch=None, source=None):
    return (recording, source, kind, start, end, p, constant, epoch, AT + datetime.timedelta(seconds=(start or end or 0) / 16000))


def streamed(spark, steps):
    sources.use_rocksdb(spark)
    run = lambda a, b: sources.live(sources.both_sources(*(x.drop("source_id").withWatermark("at", "1 second") for x in (a, b))).select(*(c.split()[0] for c in sources.ROWS.split(", "))))
    return replay_all([[spark.createDataFrame(rows, sources.ROWS) for rows in pair] for pair in steps], run)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_the_batch_result(spark, seed):
    r = random.Random(seed)
    frames, boundaries, length = [], [], 160
    for k in range(3):
        places = sorted(r.sample(range(700, length * 512 - 700), 2))
        boundaries += [(k, e + 1, at) for e, at in enumerate(places)]
        for source in sources.SOURCES:
            frames += [(k, source, i * 512, i * 512 + 512, r.choice([5, 20, 40, 60, 90]) if (i // 30) % 2 else 10, r.random() < 0.1) for i in range(length)]
    steps = [([], []) for _ in range(3)]
    for k, source, a, z, p, c in frames:
        cut = r.randrange(3) if r.random() < 0.1 else a * 3 // (length * 512)  # one in ten comes too early or too late
        steps[cut][sources.SOURCES.index(source)].append(row(k, "frame", a, z, p, c))
    for k in range(3):
        for s in range(2):
            for step, upto in enumerate((20_000, 50_000)):
                steps[step][s].append(row(k, "heard", None, upto + 1000 * s))
            # boundaries are known before the place was processed
            steps[0][s].extend(row(k, "boundary", at, epoch=e) for j, e, at in boundaries if j == k)
            steps[2][s].append(row(k, "end", length * 512))
    found = streamed(spark, steps)
    assert found.where("kind = 'rejected'").count() == 0
    sealed = found.where("kind = 'sealed'")
    want = speech.utterances_by_epoch(spark.createDataFrame(frames, "recording_id long, source_id string, start_sample long, end_sample long, p100 long, constant_block boolean"), spark.createDataFrame(boundaries, "recording_id long, epoch long, start_sample long"))
    rows = sorted(map(tuple, want.collect()))
    assert len(rows) > 12 and {x[3] for x in rows} == {0, 1, 2}
    assert sorted(map(tuple, sealed.select(*want.columns).collect())) == rows
    numbers = sources.sequenced(sealed).groupBy("recording_id").agg(F.array_sort(F.collect_list("sequence")).alias("n")).collect()
    assert all(x.n == list(range(1, len(x.n) + 1)) for x in numbers)


def test_processed_to_the_slower_of_frames_and_speakers(spark):
    talk = [row(1, "frame", i * 512, i * 512 + 512, 90, False) for i in range(400)]
    found = streamed(spark, [([*talk, row(1, "heard", None, 1000)], []), ([row(1, "heard", None, 150_000)], []), ([row(1, "heard", None, 170_000)], []), ([row(1, "heard", None, 999_999)], []), ([row(1, "end", 204_800)], [])])
    got = [(x.kind, x.start_sample, x.end_sample, x.processed) for x in found.orderBy("batch").collect()]
    # the third mark is too small an advance to be shown again
    assert got == [("open", 0, 150_000, 150_000), ("open", 0, 204_800, 204_800), ("sealed", 0, 204_800, 204_800)]


def test_refused_rows(spark):
    talk = [row(1, "frame", 0, 512, 90, False), row(1, "heard", None, 512)]
    bad = [row(1, "frame", 0, 512, 90, False), row(1, "frame", 512, 2000, 90, False), row(1, "frame", 512, 1024, 101, False), row(1, "boundary", 100, epoch=1), row(1, "end", 5), row(1, "other", 5), row(1, "frame", 1024, 1536, 90, False), row(1, "frame", 1024, 1536, 90, False)]
    found = streamed(spark, [(talk, []), (bad, []), ([row(1, "frame", 512, 1024, 90, False), row(1, "end", 1536)], []), ([row(1, "frame", 1536, 2048, 90, False)], [])])
    reasons = sorted(x.reason for x in found.where("kind = 'rejected'").collect())
    assert reasons == ["boundary", "closed", "endpoint", "invalid", "invalid", "invalid", "late", "repeated"]
    assert [(x.start_sample, x.end_sample) for x in found.where("kind = 'sealed'").collect()] == [(0, 1536)]
