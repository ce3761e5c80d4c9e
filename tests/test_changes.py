"""Changes of passages with literal rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from parley import catalog
from parley.operators import changes

ROW = "recording_id long, passage_id string, start_sample long, end_sample long, capture_source string, audio_revision int, language_epoch int, language_mode string, stream_generation int, speaker_candidates string, language string, protected string, detection_mode string, detection_reason string, speaker string, text string"
BASE = {"recording_id": 1, "passage_id": "a", "start_sample": 0, "end_sample": 16000, "capture_source": "system", "audio_revision": 1, "language_epoch": 0, "language_mode": "auto", "stream_generation": 0, "speaker_candidates": None, "language": "en", "protected": "", "detection_mode": "auto", "detection_reason": "detected", "speaker": "speaker_0", "text": "one"}


def changed(spark, *after):
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], ROW)
    return changes.interpretation_changed(frame([BASE]), frame(after)).collect()[0].changed


def test_interpretation(spark):
    for neutral in ({}, {"text": "two"}, {"speaker": "speaker_1"}, {"protected": "text"}, {"detection_reason": "best_effort"}):
        assert not changed(spark, BASE | neutral), neutral
    for touching in ({"start_sample": 1}, {"end_sample": 2}, {"capture_source": None}, {"audio_revision": 2}, {"language_epoch": 1}, {"language_mode": "manual"}, {"stream_generation": 1}, {"speaker_candidates": "x"}, {"language": None}, {"protected": "text,speaker"}, {"detection_mode": "manual"}, {"passage_id": "b"}):
        assert changed(spark, BASE | touching), touching
    assert changed(spark, BASE, BASE | {"passage_id": "b"})


def test_late_audio_keeps_words(spark):
    kind = "recording_id long, passage_id string, start_sample long, end_sample long, text string, speaker string, protected string, audio_revision int, machine_revision int, detection_reason string, audio_state string, resolution string, eligible boolean, review boolean, sealed boolean, finalized boolean, unresolved string, state string"
    row = lambda i, z, guard: (1, i, 0, z, "words", "speaker_0", guard, None, 4, "detected", "speech", "words_reviewed", True, False, False, False, None, "final")
    p = spark.createDataFrame([row("before", 16000, ""), row("at", 16001, ""), row("edited", 32000, "text")], kind)
    got = {r.passage_id: r for r in changes.invalidated(p, spark.createDataFrame([(1, 16000), (1, 20000), (2, 0)], "recording_id long, repaired_from long")).collect()}
    assert tuple(got["before"])[3:] == (16000, "words", "speaker_0", "", 0, 4, "detected", "speech", "words_reviewed", True, False, False, False, None, "final")
    assert tuple(got["at"])[3:] == (16001, "words", "speaker_0", "", 1, 5, None, None, None, None, True, True, True, "capture_audio_repaired", "unresolved")
    assert (got["edited"].text, got["edited"].state, got["edited"].review, got["edited"].audio_revision) == ("words", "final", True, 1)


def test_batches_are_whole(spark):
    jobs = lambda n: spark.createDataFrame([(i, "ab"[i % 2]) for i in range(n)], "recording_id long, kind string")
    for now, more, most, taken in ((3, 2, 5, 2), (3, 3, 5, 0), (0, 6, 5, 0), (5, 1, 5, 0), (5, 0, 5, 0), (0, 5, 5, 5)):
        assert changes.within_limit(jobs(now), jobs(more), most).count() == taken


@pytest.mark.parametrize(("busy", "taken"), [(2, [1, 3, 4]), (3, [1, 4])])
def test_the_query_and_its_sql_judge_each_batch(spark, tmp_path, busy, taken):
    """Ten recordings, so four places: two ready meetings beside two under way still fit, beside three they don't; one import does. The second of the whole batches never fits."""
    states = ["O"] * busy + ["F"] * 2 + ["P"] * (7 - busy)
    rows = [(2 * i, s) for i, s in enumerate(states)] + [(21, "F")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string").withColumns({"o_orderdate": F.lit(None).cast("timestamp"), "o_totalprice": F.lit(100.0)})
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["s13_capped_batch"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted({r[0] for r in got}) == taken
    assert got == sorted(con.execute(catalog.oracle_sql()["s13_capped_batch"]).fetchall())
